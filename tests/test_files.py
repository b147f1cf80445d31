"""Listings, slices, record containers, sinks, and what follows a run."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from plyforge.functions import scalars
from plyforge.operators import examples, image, validation
from plyforge.sources import files
from plyforge.sources.bags import BagSource, decode_value, encode_value, write_bag


def test_listing_slices_and_vocabulary(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.txt", "d.md"):
        (tmp_path / name).write_text("e2e4\nd2d4" if name == "a.txt" else "x")
    listed = files.listed_files(spark, str(tmp_path), "*.txt").collect()
    assert [(r["number"], r["path"].rpartition("/")[2]) for r in listed] == [(0, "a.txt"), (1, "b.txt"), (2, "c.txt")]
    assert [r["number"] for r in files.shard_slice(spark, str(tmp_path), "1-9", "*.txt").collect()] == [1, 2]
    with pytest.raises(FileNotFoundError):
        files.listed_files(spark, str(tmp_path), "*.bag")
    with pytest.raises(FileNotFoundError):
        files.json_items(spark, str(tmp_path))
    assert [tuple(r) for r in files.vocabulary(spark, str(tmp_path / "a.txt")).collect()] == [(0, "e2e4"), (1, "d2d4")]


def test_a_table_of_several_files_is_one_entry(spark, tmp_path):
    spark.range(4).repartition(3).write.parquet(str(tmp_path / "b.parquet"))
    for name in ("a", "c"):
        spark.range(4).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    for name in ("_d.parquet", ".e.parquet", "f.parquet"):
        (tmp_path / name).write_bytes(b"" if name[0] == "f" else b"x")  # hidden or empty
    listed = files.listed_files(spark, str(tmp_path), "*.parquet").collect()
    assert [(r["number"], r["path"].rpartition("/")[2]) for r in listed] == [(0, "a.parquet"), (1, "b.parquet"), (2, "c.parquet")]
    assert [spark.read.parquet(r["path"]).count() for r in listed] == [4, 4, 4]
    assert [r["path"].rpartition("/")[2] for r in files.shard_slice(spark, str(tmp_path), "1-9", "*.parquet").collect()] == ["b.parquet", "c.parquet"]


def test_first_characters_of_files(spark, tmp_path):
    for name, data in (("a", b"\xef\xbb\xbf \n [1]"), ("b", b"{}"), ("c", b"")):
        (tmp_path / name).write_bytes(data)
    got = files.first_character(spark, [str(tmp_path / n) for n in "abc"])
    assert list(got.values()) == ["[", "{", ""]


@pytest.mark.parametrize("suffix", ["bag", "bagz"])
def test_bags(spark, tmp_path, suffix):
    rows = [(f"fen {i} \u00e9" * (i % 40), f"m{i}", i / 7) for i in range(300)]
    for k in range(3):
        write_bag(str(tmp_path / f"{k}.{suffix}"), [encode_value(*r) for r in rows[k * 100 : k * 100 + 100]])
    (tmp_path / f"9.{suffix}").write_bytes(b"")
    spark.dataSource.register(BagSource)
    read = spark.read.format("bag").option("rowsPerTask", 33)
    assert sorted(map(tuple, read.load(str(tmp_path)).collect())) == sorted(rows)
    assert sorted(map(tuple, read.option("shards", "1-2").load(str(tmp_path)).collect())) == sorted(rows[100:200])
    assert read.load(str(tmp_path)).rdd.getNumPartitions() == 4
    # by hand: a length of 200 takes two bytes, the double is big-endian
    record = b"\xc8\x01" + b"f" * 200 + b"\x02ab" + struct.pack(">d", 0.5)
    assert decode_value(record) == ("f" * 200, "ab", 0.5) and encode_value("f" * 200, "ab", 0.5) == record


def test_one_file_for_each_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, json.dumps({"i": i})) for i in range(20)], "bucket int, line string")
    out = str(tmp_path / "out")
    assert files.write_bucket_files(rows, "bucket", "line", out) == [f"bucket_0000{i}.jsonl" for i in range(3)]
    for b in range(3):
        lines = (tmp_path / f"out/bucket_0000{b}.jsonl").read_text().splitlines()
        assert sorted(json.loads(x)["i"] for x in lines) == [i for i in range(20) if i % 3 == b]
    assert not (tmp_path / "out/_staged").exists()


def test_partials_are_merged_and_inputs_go_after_success(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(60)], "fen string, n int")
    partials = [str(tmp_path / w) for w in "ab"]
    for w, path in enumerate(partials):
        files.write_buckets(rows.where(F.col("n") % 2 == w), "fen", path, 5, compress=w == 0)
    merged = str(tmp_path / "merged")
    assert files.delete_after(spark, partials, merged) == 0 and (tmp_path / "a").exists()
    files.merge_buckets(spark, partials, merged)
    got = spark.read.parquet(merged)
    assert got.count() == 60 and got.select("bucket_id", F.input_file_name()).distinct().count() == got.select("bucket_id").distinct().count()
    assert sorted(r["n"] for r in files.read_bucket(spark, merged, 3).collect()) == sorted(r["n"] for r in rows.where(scalars.hash_bucket(F.col("fen"), 5) == 3).collect())
    assert files.delete_after(spark, partials, merged) == 2 and not (tmp_path / "a").exists()


def test_progress():
    assert files.progress(50, 5.0, 100) == {"done": 50, "rate": 10.0, "left": 5.0}
    assert files.progress(0, 0.0, 100) == {"done": 0, "rate": 0.0, "left": None}


def test_scalars_and_examples(spark):
    row = spark.range(1).select(scalars.rounded(F.lit(0.00015), 4).alias("a"), scalars.rounded(F.lit(2.5), 0).alias("b"), scalars.rounded(F.lit(float("nan")), 2).alias("c"), scalars.rounded(F.lit(None).cast("double"), 2).alias("d"), scalars.shown(F.lit("abc"), 2).alias("e"), scalars.file_number(F.lit(7)).alias("f"), scalars.unwrapped_move(F.lit('["g1f3", 0.9]')).alias("g"), scalars.unwrapped_move(F.lit("g1f3")).alias("h"), examples.pad_id(None).alias("i"), examples.pad_id(F.lit(5)).alias("j")).first()
    assert (row["a"], row["b"], row["d"], row["e"], row["f"], row["g"], row["h"], row["i"], row["j"]) == (round(0.00015, 4), 2.0, None, "ab", "00007", "g1f3", "g1f3", 0, 5)
    assert row["c"] is None
    moves = [[("a", 0.9), ("b", 0.5)], []]
    df = spark.createDataFrame([(i, "8/8/8/8/8/8/8/8 w - - 0 1", m, 3, None) for i, m in enumerate(moves)], "id int, fen string, moves array<struct<move:string,win_prob:double>>, top_n int, next_fen string")
    got = examples.texts(df, "id", "fen", "moves", "top_n", "next_fen", seed=None).collect()
    assert [r["answer"] for r in got] == ["\n[%top_3 a:<val_57> b:<val_32>]\n[%best_action a]"]
    assert examples.texts(df.withColumn("next_fen", F.col("fen")), "id", "fen", "moves", "top_n", "next_fen", with_next=False).first()["answer"].count("%FEN") == 0


def test_images(spark, tmp_path):
    import zlib

    def png(rows, colour):
        kind, data = (2, b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)) if colour else (0, b"".join(b"\0" + bytes(r) for r in rows))
        chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")

    (tmp_path / "grey.png").write_bytes(png([[0, 40, 255], [7, 8, 9]], False))
    got = image.pixels_of(spark.read.format("image").load(str(tmp_path))).orderBy("y", "x").collect()
    assert [r["v"] for r in got] == [[0], [40], [255], [7], [8], [9]]
    (tmp_path / "grey.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)]], True))
    got = image.pixels_of(spark.read.format("image").load(str(tmp_path))).orderBy("y", "x").collect()
    assert [r["v"] for r in got] == [[3, 2, 1], [6, 5, 4]]


def test_statistics_of_no_groups(spark):
    empty = spark.createDataFrame([], "b int, f int, n long, x boolean")
    row = validation.bucket_totals(validation.bucket_statistics(empty, "b", "f", "n", ["x"]), ["x"]).first()
    assert (row["buckets"], row["percent_x"]) == (0, 0.0)
    grid = spark.createDataFrame([(y, x, (x * y) % 5) for y in range(4) for x in range(6)], "y int, x int, v int")
    once, twice = (sorted(map(tuple, f(grid).collect())) for f in (lambda g: image.spread(g, image.box(3, 4), "v", True), lambda g: image.spread_box(g, 3, 4, "v", True)))
    assert once == twice
