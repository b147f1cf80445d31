"""Registered queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import ann, chat_format, decontaminate, lm_score, ngram_join, packing, secret_scan, sharding, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]

#: (host, path prefix, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_secret_scan that patterns alone decide."""
    return op1_secret_scan(spark, sf_dir).drop("spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold() != 0)
    scored = toxicity.score(docs, index)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trie = lm_score.fit(docs, learn=fold() != 1, order=3, least_count=1)
    return lm_score.score(docs, trie).select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(text))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_turns(turns))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_secret_scan, secret_base_spans, op2_decontaminate, op3_ngram_join, op4_packing, op5_toxicity, op6_lm_score, op7_url_filter, op8_sharding, op9_chat_format, op10_ann)}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (h, p, v) in sorted(enumerate(URL_RULES), key=lambda x: -len(x[1][0] + x[1][1]))) + " END"
_STRENGTH = """(SELECT coalesce(least(greatest(mean * (1 - mean) / greatest(greatest(sq / n - mean * mean, 1e-9) - mean * (1 - mean) * k / n, 1e-9) - 1, 2.0), 200.0), 200.0)
            FROM (SELECT sum(n)::DOUBLE AS n, sum(n * (bad::DOUBLE / n)) / sum(n) AS mean, sum(n * (bad::DOUBLE / n) * (bad::DOUBLE / n)) AS sq, count(*) AS k FROM {level} WHERE n > 0))"""


def _spans_sql(kind: str, order: int, pattern: str, ok: str) -> str:
    """kind, start and end of a pattern's matches: what stands between the matches gives their places."""
    return f"""SELECT r, '{kind}' AS kind, {order} AS o, pos - length(m) AS a, pos AS b FROM (SELECT r, m, sum(length(m) + length(piece)) OVER (PARTITION BY r ORDER BY i) AS pos
        FROM (SELECT r, unnest(m) AS m, unnest(pieces[1:len(m)]) AS piece, generate_subscripts(m, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS pieces FROM d))) WHERE {ok}"""


ORACLES: dict[str, str] = {
    "secret_base_spans": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({_spans_sql("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")} UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]+", "length(m) >= 24")}),
        g AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans FROM s GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)""",
    # all pairs with a common shingle, and what can be reached over links
    "op3_ngram_join": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        u AS (SELECT r, len(w) AS n, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
        g AS (SELECT DISTINCT r, sh FROM (SELECT r, p, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS sh FROM u) WHERE p + least(n, 5) - 1 <= n),
        c AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        l AS (SELECT a.r AS s, b.r AS t, count(*) AS n FROM g a JOIN g b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
        e AS (SELECT s, t FROM l JOIN c a ON s = a.r JOIN c b ON t = b.r WHERE 100 * l.n >= 80 * (a.n + b.n - l.n)),
        reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.t FROM reach JOIN e ON reach.t = e.s),
        m AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN c USING (r)""",
    "op7_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_A}', '{_Z}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT *, {_RULE.format(*(h + x for h, x, _ in URL_RULES))} AS rule, {_RULE.format(*(v for _, _, v in URL_RULES))} AS v FROM p),
        h AS (SELECT host, string_split(host, '.') AS b, count(rule) AS n, count(*) FILTER (v = 'block') AS bad FROM f GROUP BY 1),
        k AS (SELECT host, n, bad, b[-1] AS suffix, CASE WHEN len(b) <= 2 THEN host ELSE b[-2] || '.' || b[-1] END AS domain FROM h),
        dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM k GROUP BY 1, 2), tp AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY 1),
        w AS (SELECT {_STRENGTH.format(level="tp")} AS wt, {_STRENGTH.format(level="dm")} AS wd, {_STRENGTH.format(level="k")} AS wh, (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) FROM tp) AS mean),
        t2 AS (SELECT suffix, (bad + wt * mean) / (n + wt) AS up FROM tp, w), d2 AS (SELECT domain, dm.suffix, (bad + wd * up) / (n + wd) AS up FROM dm JOIN t2 ON dm.suffix = t2.suffix, w),
        h2 AS (SELECT host, (bad + wh * up) / (n + wh) AS m, n + wh AS size FROM k JOIN d2 ON k.domain = d2.domain, w)
        SELECT page_id, f.host, path, rule, coalesce(v, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM f JOIN h2 ON f.host = h2.host""",
    # what the formatted text must say, and how long it is with every backslash, < and quote escaped
    "op9_chat_format": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
        f AS (SELECT *, '<turn role="' || regexp_replace(role, '([\\<"])', '\\\1', 'g') || '">' || regexp_replace(text, '([\\<"])', '\\\1', 'g') || '</turn>' || chr(10) AS line FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, line)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, line) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(line)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    # every run of n words of a document (n: 10, or the words of a shorter item) against those of the items
    "op2_decontaminate": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS r, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (SELECT item, r, len(w) AS total, least(len(w), 10) AS n, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM b),
        ig AS (SELECT DISTINCT item, n, g FROM (SELECT item, n, p, total, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS g FROM iw) WHERE p + n - 1 <= total),
        dw AS (SELECT r, len(w) AS total, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
        dn AS (SELECT dw.*, n FROM dw, (SELECT DISTINCT n FROM ig)),
        dg AS (SELECT r, p, n, g FROM (SELECT r, p, n, total, string_agg(word, ' ') OVER (PARTITION BY r, n ORDER BY p ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS g FROM dn) WHERE p + n - 1 <= total),
        hit AS (SELECT r, p, n, item FROM dg JOIN ig USING (n, g)),
        hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
        named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)""",
}
