"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plyforge.llm import ann, arrays, chat_format, decontaminate, lm_score, ngram_join, packing, queries, secret_scan, sharding, shared, toxicity, url_filter
from plyforge.llm.elias_fano import EliasFano, Packed

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, spans string, score double"
WORDS = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "er", "ion", "ol", "ux")]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0, 1, 1, "x", 0.0) for i, t in enumerate(texts)], DOC)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, and repeated rows, with clashing columns."""
    return docs_of(spark, [None, "", "  \n ", "one", prose(random.Random(1), 30000), "same words again and again here", "same words again and again here"])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [None]).limit(0)


def near_corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    return texts + ["a b", "a b", "a", "", None] + [prose(rng, n) for n in (3, 4, 5, 6, 7, 8)]


def components(texts, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("frequent", [False, True])
def test_ngram_join_equals_brute_force(spark, monkeypatch, frequent):
    texts = near_corpus()
    if frequent:  # every shingle of two documents or more is indexed by combinations
        def found(docs, width, total):
            rows = [u for b in docs.select(F.col("text").cast("binary").alias("text")).toArrow().to_batches() for _, u in ngram_join.shingle_sets(b, "text", width)]
            v, n = np.unique((np.concatenate(rows) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            return v[n >= 2], np.where(n[n >= 2] >= 4, 3, 2).astype(np.uint8)

        monkeypatch.setattr(ngram_join, "frequent_shingles", found)
        monkeypatch.setattr(ngram_join, "BIG_HUB", 2)
        monkeypatch.setattr(ngram_join, "LEAST_COPIES", 2)  # classes of two rows and more are large
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert got == components(texts)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark):
    key, docs = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", docs_of(spark, near_corpus())
    before, was = shuffle_files(spark), spark.conf.get(key, None)
    counts = shared.Scratch(spark, "counts").save(docs.groupBy("text").count(), "counts")
    values, _ = ngram_join.frequent_shingles(docs, 5, 0)
    # ended by another thread, soon after the step
    left = next((x for _ in range(100) if not (x := shuffle_files(spark) - before) or time.sleep(0.1)), shuffle_files(spark) - before)
    assert not left and counts.count() and spark.conf.get(key, None) == was
    with pytest.raises(Exception, match="RAISE"):
        shared.Scratch(spark, "failed").save(docs.select(F.raise_error(F.lit("RAISE")).cast("string").alias("x")), "x")
    assert spark.conf.get(key, None) == was


def test_ngram_join_with_many_shared_classes(spark, monkeypatch):
    texts = near_corpus()
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.when(F.col("doc_id") > 5, None)))
    found = []
    for most in (1 << 20, 0):  # texts by a broadcast, and by a shuffle
        monkeypatch.setattr(ngram_join, "MOST_BROADCAST", most)
        found.append(sorted(map(str, ngram_join.join(docs).collect())))
    assert found[0] == found[1] and len(found[0]) == 3 * len(texts)


def test_wanted_texts_are_shuffled_once(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "c"), (None, "a b"), (None, "a b"), (0, "a b"), (1, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    wanted = docs.where("text is not null").distinct().select(F.xxhash64(F.col("id").isNull(), "id", "text").alias("cls"), "id", F.xxhash64("text").alias("th"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_shuffle = ngram_join.texts_of(docs, wanted.localCheckpoint(), False)
        assert by_shuffle._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 2
        got = sorted(bytes(r["text"]) for r in by_shuffle.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [b"a b", b"a b", b"a b", b"c"] == sorted(bytes(r["text"]) for r in ngram_join.texts_of(docs, wanted, True).collect())


def test_combination_prefixes_share_a_key():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 90))
        x = rng.choice(2**62, n, replace=False).astype(np.uint64)
        y = np.concatenate((x[: n - int(n * 0.1)], rng.choice(2**62, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            kind = lambda u: (u % np.uint64(3)).astype(np.uint8) + 1
            a, b = np.unique(x), np.unique(y)
            assert set(ngram_join.prefix_keys(a, kind(a), 80)[0].tolist()) & set(ngram_join.prefix_keys(b, kind(b), 80)[0].tolist())


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (3, 9, 10, 14, 30, 30)] + ["", None]
    texts = [None, "", prose(rng, 8)]
    for item in items[:6]:
        w = item.split()
        for k in (9, 10, 12):
            texts.append(f"{prose(rng, 20)} {' '.join(w[:k]).upper()}, {prose(rng, 20)}")
        texts.append(item)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    for part_bytes in (1 << 20, 60):
        found = {r["doc_id"]: r for r in decontaminate.find_passages(docs_of(spark, texts), bench, part_bytes=part_bytes).collect()}
        for d, t in enumerate(texts):
            w, hit, named = words(t), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        named |= windows[tuple(w[k : k + n])]
            got = {x for h in found[d]["hits"] for x in range(h["start"], h["end"])}
            assert (found[d]["n_words"], got, found[d]["items"]) == (len(w), hit, sorted(named))


def test_secrets(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n=40: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [f"{prose(rng, 30)} token = \"{key()}\" {''.join(rng.choice(WORDS) for _ in range(8))}" for _ in range(200)]
    lone = key()
    texts += [f"x {lone} y", "secret: token: abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0" * 24 + "g", "password=abc", None, ""]
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    kinds = {i: [(s["kind"], s["start"], s["end"]) for s in rows[200 + i]["spans"]] for i in range(8)}
    assert kinds == {0: [("random", 2, 42)], 1: [], 2: [], 3: [("access", 0, 20)], 4: [("hex", 0, 24)], 5: [], 6: [], 7: []}
    assert all(len(rows[i]["spans"]) == 1 for i in range(200))
    assert rows[200]["redacted"] == "x [SECRET] y"


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [None, "", " lead", "trail ", "two  spaces", "line \n  feed ", "\n\n x", "a  b"] + [prose(rng, rng.choice([1, 50, 700, 5000])) for _ in range(60)]
    rows = packing.pack(docs_of(spark, texts), path, with_ids=True).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, text in enumerate(texts):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(by[d], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == want
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and r["doc_tokens"] == len(want) // 4 for r in pieces)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_words_are_encoded_together():
    """Ordinary words don't reach the tokenizer, and ids are its own with or without the fast way."""
    rng = random.Random(16)
    encoder = packing.Encoder(queries.tokenizer_path())
    handed, real = [], encoder._encode
    encoder._encode = lambda texts: handed.extend(texts) or real(texts)
    syllables = ["er", "ción", "the", "ñ", "ß", "1", "42", "$$$", ".", "\n", "It's", "we'll", "'S", "日本", "_", "²"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) + rng.choice("abc!7") for _ in range(300)) for _ in range(20)]
    own = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == own(texts)
    assert handed == []
    parts = [*syllables, " ", " ", "  ", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "\u180e", "\u0301", "\0", "😀", "x" * 70, "'", "s", "re", "v", "<|endoftext|>"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(5000))]
    want = own(texts)
    assert encoder.encode(texts) == want and [encoder.encode([t])[0] for t in texts[:300]] == want[:300]
    assert encoder.encode([]) == [] and 0 < len(handed)
    encoder.pairs = None
    assert encoder.encode(texts) == want


def test_plan_uses_up_the_histogram():
    counts = np.random.default_rng(1).integers(0, 50, 65)
    counts[0] = 0
    used = np.zeros(65, int)
    for c, n in packing.plan(counts, 64):
        assert sum(c) <= 64
        for b in c:
            used[b] += n
    assert (used == counts).all()


def test_toxicity_neighbours_are_exact(spark):
    rng = random.Random(7)
    texts = [prose(rng, 40) + (" " + rng.choice(["scumbag", "idiotic"]) if i % 4 == 0 else "") for i in range(200)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, index).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 == 0) for i in range(150, 200))
    full = np.zeros((len(index.positive), len(index.terms)))
    for t in range(len(index.terms)):
        for b in range(index.n_blocks):
            some = slice(index.starts[t * index.n_blocks + b], index.starts[t * index.n_blocks + b + 1])
            full[index.docs[some], t] = index.weights[some]
    for text in texts[:30]:
        data = np.frombuffer(text.encode(), np.uint8)
        terms, n = next(toxicity.row_terms(index, data, np.array([0, len(data)])))
        every = np.sort(full[:, terms] @ index.unit(terms, n))[::-1]
        want = every[every >= max(every[index.k - 1] - 1e-9, 1e-12)]  # with all that tie with the last
        got = index.nearest(terms, index.unit(terms, n))[1]
        assert np.allclose(got, want)


def test_toxicity_votes_do_not_grow_with_the_labels(spark):
    texts = [("awful nasty words " if i % 4 == 0 else "quiet friendly lines ") + str(i) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    index = toxicity.fit(docs_of(spark, texts), labels, per_class=20)
    # 20 of 40 toxic rows and 20 of 120 others: weights 1 to 3 with mean 1
    assert sorted(set(index.votes.round(9))) == [0.5, 1.5] and index.votes.mean() == pytest.approx(1)
    assert (index.votes[index.positive] == 0.5).all() and index.base == pytest.approx(0.25)


def test_passages_of_items_without_an_id(spark):
    rng = random.Random(41)
    long = prose(rng, 30)
    items = spark.createDataFrame([(None, long), (None, "zq zw zx"), ("named", long), (None, None)], "item_id string, text string")
    docs = docs_of(spark, [f"before {long} after", "the zq zw zx there", "clean"])
    for part_bytes in (1 << 20, 10):
        got = {r["doc_id"]: r for r in decontaminate.find_passages(docs, items, part_bytes=part_bytes).collect()}
        assert [(h["start"], h["end"]) for h in got[0]["hits"]] == [(1, 31)] and got[0]["items"] == ["named"]
        assert [(h["start"], h["end"]) for h in got[1]["hits"]] == [(1, 4)] and got[1]["items"] == []
        assert got[2]["hits"] == [] and got[2]["items"] == []


def test_joined_benchmark_equals_the_searched_one(spark, odd, empty):
    items = spark.createDataFrame([(0, "same words again and again here"), (1, "one"), (2, prose(random.Random(1), 200)), (2, ""), (3, None)], "item_id int, text string")
    passed = ("text", "source", "size")
    rows = lambda docs, most: sorted(map(repr, decontaminate.find_passages(docs, items, part_bytes=most, passed=passed).collect()))
    assert rows(odd, 0) == rows(odd, 1 << 20) and len(rows(odd, 0)) == odd.count()
    assert rows(empty, 0) == []
    clashing = odd.select("doc_id", "text", F.lit(1).alias("d"), F.lit("s").alias("salt"), F.lit("c").alias("c0"))
    got = decontaminate.find_passages(clashing, items, part_bytes=0, passed=("d", "salt", "c0"))
    assert got.columns == ["doc_id", "d", "salt", "c0", "n_words", "hits", "items"]
    assert got.where("size(hits) > 0").count() == 4 and got.where("d = 1 and salt = 's' and c0 = 'c'").count() == odd.count()


def test_rest_of_a_run_around_a_pattern_is_scored():
    model = secret_scan.RatioModel(np.full((secret_scan.WIDTH, secret_scan.WIDTH), 2.0))
    key, hexes = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    left, right = "xQ9zKd81LmPw4TyUvB", "G" + "hTrQz9mN2kLpXw7"
    text = f"see {left}{hexes}{right} and {key}{left} and short{hexes}Zz"
    base, found = secret_scan.find(text, model)
    assert secret_scan.left_runs("ab" * 9, []) == [(0, 18)]
    taken = [text[a:b] for a, b, k in found if k == 3]
    # capitals after the key belong to the access pattern, so the rest starts at the lower-case letter
    assert taken == [left, right, left]
    assert {s for s in found if s[2] < 3} == set(base)
    assert left not in secret_scan.redacted(text, found)


@pytest.mark.parametrize("least", [1, 2])
def test_lm_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(lm_score, "SHARD", 300)  # more shards than shuffle partitions
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", "unseen " + prose(rng, 5)]
    trie = lm_score.fit(docs_of(spark, texts[:60]), order=3, least_count=least)
    assert len(trie.levels[1]) > 4
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    tokens = lambda t: [*(t or "").lower().split(), None]
    for t in texts[:60]:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(w, w[1:], strict=False))
        tri.update(x for x in zip(w, w[1:], w[2:], strict=False) if bi.get(x[:2], 0) or True)
    kept = {k for k, n in bi.items() if n >= least}
    total, v = sum(uni.values()), len(uni)

    def level(counts, context, word, shorter, usable=lambda c: True):
        after = {k: n for k, n in counts.items() if k[:-1] == context}
        if not usable(context) or not any(n >= least for n in after.values()):
            return shorter
        c = sum(after.values())
        left = max(1e-8, 1 - sum(n - 0.6 for n in after.values() if n >= least) / c)
        code = lambda p: 10 ** (-np.ceil(-np.log10(p) * 32 - 1e-9).clip(0, 255) / 32)
        rest = max(1, np.ceil(-np.log10(left) * 32 - 1e-9).clip(0, 255))
        n = after.get((*context, word), 0)
        return (code((n - 0.6) / c) if n >= least else 0) + 10 ** (-rest / 32) * shorter

    for r in lm_score.score(docs_of(spark, texts), trie).collect():
        w = tokens(texts[r["doc_id"]])
        base = model = 0.0
        for i, x in enumerate(w):
            p = (uni[x] + 0.5) / (total + 0.5 * (v + 1))
            base += np.log10(p)
            if i >= 1:
                p = level(bi, (w[i - 1],), x, p)
            if i >= 2:
                p = level(tri, (w[i - 2], w[i - 1]), x, p, lambda c: c in kept)
            model += np.log10(p)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(uni[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(model)


def test_lm_query_knows_single_occurrences_and_trigrams(spark, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    texts = {learned[0]: "red fox one", learned[1]: "blue fox two", held[0]: "red fox one", held[1]: "red fox two", held[2]: "two one blue"}
    spark.createDataFrame([(i, t, "en", "s", 0, 1, 1, "x", 0.0) for i, t in texts.items()], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_lm_score(spark, str(tmp_path)).collect()}
    assert [got[i]["held_out"] for i in held[:3]] == [True] * 3
    # every bigram of the first occurs once; the first two differ only in what follows 'red fox'
    assert got[held[0]]["score"] > got[held[0]]["base_score"] + 0.5
    assert got[held[0]]["score"] > got[held[1]]["score"] + 0.5
    assert got[held[2]]["score"] < got[held[1]]["score"]


def test_lm_children_by_pointers(spark):
    texts = ["a b", "a c", "a b", "d b a"]
    trie = lm_score.fit(docs_of(spark, texts), order=2, least_count=1)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b c d"])], ["text"])
    a, b, c, d, end = trie.ids(next(lm_score.token_blocks(batch, "text"))[2])[0].tolist()
    assert min(a, b, c, d, end) >= 0
    for context, after in ((a, {b, c, end}), (b, {a, end}), (c, {end}), (d, {b}), (end, set())):
        assert lm_score.children(trie, 2, context).tolist() == sorted(after)


def test_packed_numbers():
    rng = np.random.default_rng(10)
    for width in (0, 1, 3, 17, 43, 63, 64):
        values = rng.integers(0, 2 ** min(width, 63), 1000, dtype=np.uint64)
        assert (Packed.build(values, width)[np.arange(1000)] == values).all()


def test_elias_fano():
    rng = np.random.default_rng(9)
    for universe in (1, 300, 10**6, 2**40, 2**62):
        values = np.unique(rng.integers(0, universe, 500))
        ef, n = EliasFano.build(values, universe), len(values)
        assert (ef.at(np.arange(n)) == values.astype(np.uint64)).all()
        assert all((a == values[i : n - 1 + i]).all() for i, a in enumerate(ef.pair(np.arange(n - 1))))
        probe = np.unique(np.concatenate((values, rng.integers(0, universe, 300))))
        at, found = ef.successor(probe, np.zeros(len(probe), np.int64), np.full(len(probe), n))
        assert (found == np.isin(probe, values)).all()
        assert (values[at[found]] == probe[found]).all()


@pytest.mark.parametrize(("vocabulary", "contexts"), [(7, 2000), (100, 3000), (30000, 3000), (10**6, 300)])
def test_successor_within_a_context(vocabulary, contexts):
    rng = np.random.default_rng(11)
    sizes = np.minimum(rng.zipf(1.3, contexts), vocabulary)
    sizes[rng.random(contexts) < 0.3] = 0
    sizes[10:14] = min(vocabulary, 20000)  # full and very large neighbours
    values = np.concatenate([np.sort(rng.choice(vocabulary, n, replace=False)) + r * vocabulary for r, n in enumerate(sizes)]).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    pointers, listed = EliasFano.build(first, len(values) + 1), EliasFano.build(values, contexts * vocabulary)
    x = np.concatenate((rng.choice(values, 5000), rng.integers(0, contexts * vocabulary, 5000)))
    start, end = (p.astype(np.int64) for p in pointers.pair(x // vocabulary))
    assert (start == first[x // vocabulary]).all() and (end == first[x // vocabulary + 1]).all()
    at, found = listed.successor(x, start, end)
    assert (found == np.isin(x, values)).all() and (values[at[found]] == x[found]).all()


def test_search_in_a_large_bucket_reads_few_values(monkeypatch):
    rng = np.random.default_rng(12)
    vocabulary, sizes = 10**6, [1] * 3000 + [20000, 5, 40000] + [1] * 3000
    values = np.concatenate([np.sort(rng.choice(vocabulary, n, replace=False)) + r * vocabulary for r, n in enumerate(sizes)]).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    listed = EliasFano.build(values, len(sizes) * vocabulary)
    again = EliasFano(listed.arrays(), listed.n, listed.bits)
    x = np.sort(np.concatenate((rng.choice(values, 5000), rng.integers(2990 * vocabulary, 3010 * vocabulary, 5000))))
    reads, get = [], Packed.__getitem__
    monkeypatch.setattr(Packed, "__getitem__", lambda self, i: reads.append(len(i)) or get(self, i))
    at, found = again.successor(x, first[x // vocabulary], first[x // vocabulary + 1])
    assert sum(reads) <= 6 * len(x)  # by halving the bucket 15 for most
    assert (found == np.isin(x, values)).all() and (values[at[found]] == x[found]).all()


def test_lm_reads_pointers_once_for_each_context(spark, monkeypatch):
    texts = [f"a w{i % 50} a" for i in range(60)] + ["b a"]
    trie = lm_score.fit(docs_of(spark, texts), order=2, least_count=1)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(["a b", *(f"w{i}" for i in range(50))]).encode()])], ["text"])
    a, b, *w = trie.ids(next(lm_score.token_blocks(batch, "text"))[2])[0][:-1].tolist()
    context, token = np.array([a] * 50 + [-1, b, b, a, a]), np.array([*w, w[0], a, w[3], -1, w[1]])
    one = [np.concatenate(x) for x in zip(*(trie.find(2, context[i : i + 1], token[i : i + 1]) for i in range(len(token))), strict=True)]
    asked, pair = [], EliasFano.pair
    monkeypatch.setattr(EliasFano, "pair", lambda self, i: asked.extend(i.tolist()) or pair(self, i))
    got = trie.find(2, context, token)
    assert len(asked) == 2
    assert all((x == y).all() for x, y in zip(got, one, strict=True))
    assert (trie.find(2, context, token, values=False)[0] == got[0]).all()
    node, found, left = got
    assert (node >= 0).tolist() == [True] * 50 + [False, True, False, False, True]
    assert ((found > 0) == (node >= 0)).all() and left[50] == 1 and (np.delete(left, 50) < 1).all()


def test_hashes_of_blocks_are_those_of_words():
    rng = np.random.default_rng(13)
    for n in (1, 4096, 32768, 32769, 200000):
        for blank in (0, 0.0001, 0.2, 1):  # some words are longer than a step of multipliers
            data = rng.integers(33, 256, n).astype(np.uint8)
            data[rng.random(n) < blank] = 32
            starts, ends, _ = arrays.words(data, np.array([0, n // 3, n]), arrays.SPACED)
            assert (arrays.block_hashes(data, starts, ends) == arrays.word_hashes(data, starts, ends)).all()


def test_url_filter(spark):
    urls = [("http://A.Org", "a.org", "", None), ("x", "", "", None), (None, "", "", None), ("http://example.org/es/1?x", "example.org", "/es/1", "example.org/es/"), ("http://m.example.org/en/12#t", "m.example.org", "/en/12", "example.org/en/1"), ("http://b.org/z", "b.org", "/z", "org/"), ("http://c.com/de/", "c.com", "/de/", "com/de/"), ("http://xorg/de/", "xorg", "/de/", None)]
    more = [("http://bad.com/de/%d" % i, "bad.com", "/de/%d" % i, "com/de/") for i in range(60)] + [("http://bad.com/en/1", "bad.com", "/en/1", None), ("http://new.net/a", "new.net", "/a", None)] + [("http://h%d.org/a" % i, "h%d.org" % i, "/a", "org/") for i in range(100)]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls + more)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    for i, (_, host, path, rule) in enumerate(urls + more):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
    assert got[len(urls) + 60]["verdict"] == "block"
    assert got[len(urls) + 61]["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_sharding(spark, odd):
    assert sharding.smallest_capacity(np.array([5, 1, 1, 1, 5]), 3) == 5
    rng = random.Random(10)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 12))])
        k = rng.randint(1, 5)
        capacity, cuts = sharding.minimax_cuts(sizes, k)
        sums = [sizes[a:b].sum() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        assert cuts[-1] == len(sizes) and max(sums) <= capacity
        c = np.cumsum(sizes)
        assert capacity == sizes.max() or sharding.greedy_cuts(c, capacity - 1, k) is None
    texts = [prose(rng, 20) for _ in range(300)] + ["copy"] * 40 + [None, ""]
    rows = sharding.shard(docs_of(spark, texts), shards=5).collect()
    assert len(rows) == len(texts)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if 300 <= r["doc_id"] < 340}) == 1


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", 'a"<b>\\', "", None, '<turn role="user">', "line\n</turn>\n", "\\\\<"]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(zip(["system", "user", "assistant", None, "assistant", 'we"ird\\<', "assistant"], texts, strict=True))]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat_format.read_back(formatted).collect():
        mine = [x for x in rows if x[0] == r["conv_id"]]
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (7, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    parts = [("text", "see <", None, None, None, None, None), ("image", None, "i.png", 56, 57, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    row = chat_format.format_turns(df, parts_col="parts").first()
    assert row["formatted"] == '<turn role="user">see \\<<image 0><audio 1><document 2></turn>\n'
    assert [a["tokens"] for a in row["attachments"]] == [6, 25, 1536]
    assert len(chat_format.parse(row["formatted"])) == 1


def test_ann_finds_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 16)).astype("float32")
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(3000, None, 0), (3100, [0.0] * 16, 0), (3200, [float("nan")] * 16, 0), (3300, [1.0, None] * 8, 0), (3400, [1.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 100 == 0, block_rows=400).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    assert [v for _, v, _ in sorted(got[0])] == list(range(100, 110))
    hit = 0
    for q in got:
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len({v for _, v, _ in got[q]} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in got[q])
    assert hit >= 0.9 * 10 * len(got)
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_toxicity_ties_share_the_places_left():
    index = toxicity.BlockMaxIndex(np.array([7], np.uint64), np.ones(1), np.array([True] * 10 + [False] * 30), np.array([str(i) for i in range(40)], object), np.ones(40), 0.25)
    one = (np.zeros(1, np.int64), np.ones(1))
    index.build([one] * 40)
    share, near, cosine = index.score(np.zeros(1, np.int64), np.ones(1))
    # all 40 tie, so the 15 places hold a quarter of toxic votes whatever the order
    assert len(near) == 40 and share == pytest.approx(0.25) and (cosine == 1).all()


def test_toxicity_evidence_names_the_neighbours(spark):
    texts = [("awful nasty words " if i % 4 == 0 else "quiet friendly lines ") + str(i) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    index = toxicity.fit(docs_of(spark, texts), labels)
    for r in toxicity.score(docs_of(spark, texts[:8]), index).collect():
        assert 0 < len(r["evidence"]) <= 3
        assert all((int(e["id"]) % 4 == 0) == e["toxic"] == (r["doc_id"] % 4 == 0) for e in r["evidence"])


def test_words_of_any_length_are_told_apart(spark):
    a, b = "a" * 4096, "b" * 4096
    rest = " ".join(f"w{i}" for i in range(4))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs_of(spark, [f"{a}{b} {rest}", f"{b}{a} {rest}", f"{a}{b} {rest}"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    with pytest.raises(ValueError, match="above 75"):
        ngram_join.join(docs_of(spark, ["x"]), percent=75)


def test_key_words_are_ascii():
    for text in ("to\u212aen=abcdefgh", "pa\u017f\u017fword=abcdefgh"):
        assert secret_scan.pattern_spans(text) == []
    assert secret_scan.pattern_spans("ToKeN=abcdefgh") == [(0, 14, 0)]


def base_spans(text):
    """By scanning from each position, without the module's patterns."""
    spans, alphabet = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    names = ["password", "passwd", "secret", "token", "api_key", "apikey"]

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        for name in names:
            if not low.startswith(name, at):
                continue
            q = at + len(name)
            q += q < len(text) and text[q] in "\"'"
            q = run(q, " ")
            if q < len(text) and text[q] in ":=":
                q = run(q + 1, " ")
                q += q < len(text) and text[q] in "\"'"
                end = run(q, alphabet)
                if end > q:
                    if end - q >= 6:
                        spans.append((at, 0, end))
                    at = end - 1
                    break
        at += 1
    at = 0
    while at < len(text):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", at) else at
        if end > at + 4:
            spans += [(at, 1, end)] * (end - at >= 20)
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        spans += [(at, 2, end)] * (end - at >= 24)
        at = max(end, at + 1)
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


def test_secret_query_against_a_plain_scan(spark, tmp_path):
    rng = random.Random(14)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", "  ", ":", "=", "abcdef", "x9", "AKIA", "AKIA" + "Z" * 16, "0" * 23, "deadbeef" * 3, ".", "\u00e9", "-", "k", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op1_secret_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))


def test_secret_models_from_given_samples(spark):
    rng = random.Random(15)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(key(), True) for _ in range(60)] + [("".join(rng.choice(WORDS) for _ in range(9)), False) for _ in range(200)] + [(None, True), ("x", None)]
    model = secret_scan.train(docs_of(spark, []), samples=spark.createDataFrame(rows, "run string, is_secret boolean"))
    assert sum(model.is_secret(key()) for _ in range(50)) >= 48
    assert not any(model.is_secret("".join(rng.choice(WORDS) for _ in range(9))) for _ in range(50))


def test_rules_joined_by_host_equal_those_in_the_plan(spark, monkeypatch):
    rng = random.Random(16)
    parts = ["a", "b", "ab", "org"]
    urls = ["://".join(("http", f"{'.'.join(rng.choice(parts) for _ in range(rng.randint(1, 4)))}/{rng.choice('xy')}{rng.choice('xy')}?q")) for _ in range(200)] + [None, "none", "http://"]
    rules = [(".".join(rng.choice(parts) for _ in range(rng.randint(1, 3))), "/" + rng.choice(["", "x", "xy", "y"]), rng.choice(["allow", "block"])) for _ in range(30)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    plain = sorted(map(str, url_filter.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_RULES", 5)
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", 0)
    assert sorted(map(str, url_filter.judge(pages, rules).collect())) == plain
    for r in url_filter.judge(pages, rules).collect():
        fits = [x for x in rules if (r["host"] == x[0] or r["host"].endswith("." + x[0])) and r["path"].startswith(x[1])]
        longest = max((len(x[0]) + len(x[1]), x) for x in fits)[1] if fits else None
        assert r["rule"] == (longest and longest[0] + longest[1]) and (not longest or r["verdict"] == longest[2])


def test_url_posterior_by_hand(spark):
    rows = [("a.x", "block")] * 6 + [("a.x", "allow")] * 2 + [("b.x", "allow")] * 10 + [("c.x", None)]
    pages = spark.createDataFrame([(i, f"u://{h}/{v or 'none'}") for i, (h, v) in enumerate(rows)], "page_id long, url string")
    got = {r["host"]: r for r in url_filter.judge(pages, [("x", "/block", "block"), ("x", "/allow", "allow")]).collect()}
    up = 7 / 20  # (blocked + 1) / (labelled + 2)

    def weight(groups):
        n, bad = sum(g[0] for g in groups), sum(g[1] for g in groups)
        mean = bad / n
        spread = max(sum(b * b / m for m, b in groups) / n - mean * mean, 1e-9)
        between = max(spread - mean * (1 - mean) * len(groups) / n, 1e-9)
        return min(max(mean * (1 - mean) / between - 1, 2.0), 200.0)

    top, hosts = weight([(18, 6)]), weight([(8, 6), (10, 0)])
    up = (6 + top * up) / (18 + top)
    for host, n, bad in (("a.x", 8, 6), ("b.x", 10, 0), ("c.x", 0, 0)):
        domain = (bad + hosts * up) / (n + hosts)
        mean = (bad + hosts * domain) / (n + hosts)
        assert got[host]["block_rate"] == pytest.approx(mean)
        assert got[host]["block_bound"] == pytest.approx(mean - 1.645 * (mean * (1 - mean) / (n + hosts + 1)) ** 0.5)


def test_shard_query_columns(spark, tmp_path):
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(["", "\u00e9\u00df"]) for _ in range(200)] + ["copy"] * 30 + [None, "", None]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_sharding(spark, str(tmp_path)).collect()
    atoms = collections.defaultdict(int)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        atoms[hashlib.md5(data).hexdigest()[:4]] += len(data) + 8
    # brute force over all capacities that some run of atoms has: the smallest that 24 shards can hold
    sizes = [atoms[k] for k in sorted(atoms)]

    def needed(capacity):
        n = now = 0
        for x in sizes:
            if n == 0 or now + x > capacity:
                n, now = n + 1, 0
            now += x
        return n

    sums = {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}
    best = min(c for c in sums if c >= max(sizes) and needed(c) <= 24)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert set(shards) <= set(range(24)) and max(sum(r["size"] for r in some) for some in shards.values()) == best
    for some in shards.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "copy"}) == 1


def test_repeated_ids_and_vectors_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [5.0, 5.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 3)) for r in ann.search(df, F.col("id") % 100 == 0).collect())
    far = [round(((5 - 1) ** 2 + (5 - y) ** 2) ** 0.5, 3) for y in (0, 0.1)]
    assert got == sorted([(0, 1, 2, 0.0), (0, 2, 2, 0.0), (0, 3, 0, 0.1), (0, 4, 1, far[0])] + [(0, 1, 0, 0.1), (0, 2, 2, 0.1), (0, 3, 2, 0.1), (0, 4, 1, far[1])])


def test_chat_ids_of_any_type_null_parts_and_ties(spark):
    rows = [("b", 0, "user", "x"), ("b", 0, "user", "a"), ("b", 0, "user", "a"), (None, 1, "assistant", "y"), (None, None, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert got["b"]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nx\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\nz\nassistant\ny\n").hexdigest()
    part = ("text", "see", None, None, None, None, None)
    df = spark.createDataFrame([(1, 0, "user", [None, part]), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    assert [r["formatted"] for r in chat_format.format_turns(df, parts_col="parts").orderBy("turn").collect()] == ['<turn role="user">see</turn>\n', '<turn role="user"></turn>\n']
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).count() == 0
    with pytest.raises(ValueError, match="unknown part"):
        chat_format.PartVisitor().visit({"type": "video"})


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "yarn"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(Session)


def test_passed_columns_must_not_clash(spark):
    docs = docs_of(spark, ["x"])
    for call in (lambda: secret_scan.scan(docs, passed=("spans",)), lambda: toxicity.score(docs, None, passed=("score",)), lambda: lm_score.score(docs, None, passed=("score",)), lambda: decontaminate.find_passages(docs.withColumnRenamed("size", "hits"), docs, passed=("hits",))):
        with pytest.raises(ValueError, match="share names"):
            call()


def test_odd_texts_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    runs = {
        "secrets": lambda d: secret_scan.scan(d), "passages": lambda d: decontaminate.find_passages(d, bench), "join": lambda d: ngram_join.join(d),
        "pack": lambda d: packing.pack(d, queries.tokenizer_path()).select("doc_id").distinct(), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "lm": lambda d: lm_score.score(d, lm_score.fit(d)), "shard": lambda d: sharding.shard(d),
    }
    for name, run in runs.items():
        assert run(odd).count() == 7, name
        assert run(empty).count() == 0, name
