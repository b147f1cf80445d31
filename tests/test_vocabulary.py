import math

from pyspark.sql import functions as F

from plyforge.operators import image, vocabulary


def test_extended_vocabulary_is_contiguous(spark):
    moves = spark.createDataFrame([(0, "e2e4"), (1, "g1f3")], "idx int, move string")
    rows = vocabulary.extended(spark, moves, 1000).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1000, 1000 + 9 + 64 + 2))
    assert rows[8]["token"] == "%top_30" and rows[9]["token"] == "<val_0>" and rows[-1]["token"] == "g1f3"


def test_move_names(spark):
    names = vocabulary.move_names(spark)
    assert {r["kind"]: r["count"] for r in names.groupBy("kind").count().collect()} == {"line": 1456, "leap": 336, "promotion": 176}
    assert names.select("move").distinct().count() == 1968


def test_token_ids_of_odd_texts(spark):
    words = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id int")
    rows = spark.createDataFrame([(1, " b a\nc b"), (2, None), (3, "")], "k int, t string")
    assert {r["k"]: r["ids"] for r in vocabulary.token_ids(rows, "k", "t", words).collect()} == {1: [8, 7, -1, 8], 2: [], 3: []}


def test_new_vectors(spark):
    stats = spark.createDataFrame([(0, 5.0, 2.0), (1, -1.0, None)], "dim int, mean double, std double")
    rows = [r["vector"] for r in vocabulary.new_vectors(spark.range(4000), "id", stats, 1).orderBy("id").collect()]
    again = [r["vector"] for r in vocabulary.new_vectors(spark.range(4000).repartition(7), "id", stats, 1).orderBy("id").collect()]
    assert rows == again and all(v[1] == -1.0 for v in rows)
    mean = sum(v[0] for v in rows) / 4000
    assert abs(mean - 5) < 0.15 and abs(math.sqrt(sum((v[0] - mean) ** 2 for v in rows) / 3999) - 2) < 0.1


def test_kernel_and_marks(spark):
    assert image.kernel(["101", "020"]) == [(-1, -1), (-1, 1), (0, 0)]
    rows = spark.createDataFrame([(255, [1, 2, 3]), (0, [1, 2, 3])], "m int, p array<int>")
    assert [r["c"] for r in rows.select(image.marked(F.col("m"), F.col("p")).alias("c")).collect()] == [[0, 255, 0], [1, 2, 3]]
