import json

import pytest
from pyspark.sql import functions as F

from plyforge.functions import rendering, scalars
from plyforge.operators import metrics, sequences
from plyforge.sources import files
from plyforge.streaming.files import drain, file_stream

FEN = "2r3k1/5pp1/7p/3N4/8/1P4P1/5P1P/3R2K1 b - - 4 27"
SQUARES = "..r...k......pp........p...N.............P....P......P.P...R..K."


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("fen", "want"), [(FEN, SQUARES + " b .... -. .4 .27"), (" 8/8/8/8/8/8/8/8  w Kq d6 7 12", "." * 64 + " w Kq.. d6 .7 .12"), ("8/8/8/8/8/8/8/8 b k c3 123 4567", "." * 64 + " b k... c3 123 4567")])
def test_fixed_fen(spark, fen, want):
    assert one(spark, scalars.fixed_fen(F.lit(fen))) == want


@pytest.mark.parametrize(("p", "want"), [(0.0, 0), (0.1, 6), (0.333, 21), (0.61, 38), (0.9, 57), (1.0, 63), (-3.0, 0), (7.5, 63), (float("nan"), 63), (float("inf"), 63), (None, None)])
def test_value_bucket(spark, p, want):
    assert one(spark, scalars.value_bucket(F.lit(p).cast("double"))) == want


def test_answer_and_prompt(spark):
    moves = F.array(F.struct(F.lit("d1d4").alias("move"), F.lit(0.61).alias("win_prob")))
    assert one(spark, rendering.answer(moves, F.lit(3), F.lit(None).cast("string"))) == "\n[%top_3 d1d4:<val_38>]\n[%best_action d1d4]"
    assert one(spark, rendering.prompt(F.lit(FEN), F.lit(3))).startswith("<|chess|> %prev_FEN %top_3 %best_action %FEN\n[%prev_FEN ..r...k.")
    assert one(spark, rendering.prompt(F.lit(FEN), F.lit(3), False)).startswith("<|chess|> %prev_FEN %top_3 %best_action\n[%prev_FEN ")


def test_sequences(spark):
    ids, mask, labels = sequences.joined_sequence(F.array(*[F.lit(x).cast("bigint") for x in (1, 2)]), F.array(*[F.lit(x).cast("bigint") for x in (3, 4, 5)]), 4)
    row = spark.range(1).select(ids.alias("i"), mask.alias("m"), labels.alias("l")).first()
    assert (row["i"], row["m"], row["l"]) == ([1, 2, 3, 4], [1] * 4, [-100, -100, 3, 4])


def test_losses_without_tokens_and_with(spark):
    schema = "logits array<double>, label long"
    assert metrics.masked_losses(spark.createDataFrame([], schema), 2, 66).first()["total"] == 0
    rows = [([0.0] * 70, 1), ([0.0] * 70, 10), ([0.0] * 70, -100)]
    got = metrics.masked_losses(spark.createDataFrame(rows, schema), 2, 66).first()
    assert got["ce"] == pytest.approx(4.248495, 1e-6)
    assert got["hl"] == pytest.approx(4.158883, 1e-6)


def test_json_items_and_buckets(spark, tmp_path):
    item = {"fen": FEN, "moves": [["d1d4", 0.9]], "best_action": "g1g2", "next_fen": None}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps(item) + "\n\nnot json\n" + json.dumps({"fen": "x"}) + "\n")
    (tmp_path / "in/b.json").write_text(json.dumps([item, item], indent=1))
    rows = files.json_items(spark, str(tmp_path / "in"))
    assert rows.count() == 3
    assert rows.first()["moves"][0]["win_prob"] == 0.9
    files.write_buckets(rows.select("fen", "best_action"), "fen", str(tmp_path / "out"), 10)
    buckets = spark.read.parquet(str(tmp_path / "out")).select("bucket_id").distinct().collect()
    assert len(buckets) == 1
    assert files.read_bucket(spark, str(tmp_path / "out"), buckets[0][0]).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"fen": FEN, "n": i}) + "\n")
    drain(file_stream(spark, str(tmp_path / "in"), "fen string, n int").select(scalars.fixed_fen(F.col("fen")).alias("f"), "n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_json_items_are_the_same_by_file_form(spark, tmp_path):
    items = ['{"fen": null, "moves": [["e2e4", "0.5"]], "best_action": "e2e4"}', '{"fen": "f", "moves": null, "best_action": null, "next_fen": "a [b], c"}', '{"fen": "g", "moves": []}']
    got = []
    for name, text in (("a.jsonl", "\n".join(items)), ("a.json", "[" + ",\n".join(items) + "]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text(text)
        got.append(sorted(map(tuple, files.json_items(spark, str(tmp_path / name)).collect()), key=str))
    assert len(got[0]) == 2 and got[0] == got[1]
