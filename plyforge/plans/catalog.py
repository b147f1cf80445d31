"""Registered queries of the library's operators, with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import moves, rendering, scalars
from ..functions.scalars import hash_bucket, percent, value_bucket, value_token
from ..operators import examples, image, metrics, ranking, sampling, sequences, validation, vocabulary
from ..sources import files

FLAGSHIP = "rank_by_key"
TYPES = ("click", "view", "purchase", "signup", "logout")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"))


def _top_text(item: str) -> F.Column:
    return F.array_join(F.transform("top", lambda m: F.concat(m[item].cast("string"), F.lit(":"), value_token(value_bucket(m["score"])))), " ")


def rank_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.summary(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score")
    return out.select("l_orderkey", "n_items", "best", _top_text("l_linenumber").alias("top5"))


def rank_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_discount") * 10).alias("score"))
    out = ranking.summary(rows, "l_suppkey", "l_partkey", "score")
    return out.select("l_suppkey", "n_items", "best", _top_text("l_partkey").alias("top5"))


def rank_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.summary(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score")
    place = ranking.rank_of(F.col("top"), F.lit(2), "l_linenumber")
    return out.select("l_orderkey", place.alias("rank_of_2"), (F.col("best") == 2).alias("agrees"))


def value_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.summary(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score")
    tie, losing = ranking.value_flags(F.col("top"), "score", 5, 0.5, 0.3)
    return validation.totals(out.select(tie.alias("tiebreak"), losing.alias("losing")), ["tiebreak", "losing"])


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(hash_bucket(F.col("text"), 1000).alias("bucket_id"), F.md5(F.col("text").cast("binary")).alias("k"))
    return rows.groupBy("bucket_id", "k").agg(F.count("*").alias("n")).groupBy("bucket_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))


def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    return validation.difference(events, events.where("value > 100"), ["user_id", "event_type"])


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _order_items(spark, sf_dir)
    expected = data.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("l_linenumber"))
    return validation.completeness(data, expected, "l_orderkey", "l_linenumber")


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ranking.best_per_item(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = groups.groupBy((F.col("l_orderkey") % 30).alias("bucket_id")).agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") >= 6).alias("n_complete"), F.sum("n").alias("n_items"))
    return out.select("*", F.round(percent(F.col("n_complete"), F.col("n_keys")), 6).alias("percent_complete"))


def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(value_bucket(F.col("value") / 250).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", value_token(F.col("bucket")).alias("token"), "n")


def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    vocab = part.where("p_size <= 2").select("p_type").distinct().select("p_type", F.lit(True).alias("known"))
    out = part.join(vocab, "p_type", "left")
    return out.select("p_partkey", F.when(F.col("known"), F.col("p_type")).otherwise(F.concat(F.lit("<m_"), F.col("p_type"), F.lit(">"))).alias("token"), F.col("known").isNull().alias("is_oov"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").where(F.array_contains(F.json_object_keys("props"), "k"))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def balanced_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.balanced_choice(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [3, 5, 10, 20, 30])
    return out.select("o_orderkey", "top_n")


def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_split(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.05, seed=1).select("o_orderkey", "is_eval")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.batches(rows, "o_orderpriority", "o_orderkey", 16, drop_last=True).select("o_orderkey", "o_orderpriority", "batch", "place")


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_counts(_t(spark, sf_dir, "orders"), "o_orderpriority", 16)


def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_per_group(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.file_index(_t(spark, sf_dir, "documents"), "source")


def padded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"))
    out = sequences.padded(rows, "conv_id", {"ids": F.lit(0).cast("bigint")})
    return out.select("conv_id", "turn", F.size("ids").cast("bigint").alias("padded"), F.size(F.filter("ids", lambda x: x == 0)).cast("bigint").alias("zeros"))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.split("text", " ").alias("ids"))
    return sequences.length_stats(rows, "ids")


def next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.next_token(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("event_id", "target")


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), "label")
    return rows.select("vec_id", F.round(metrics.cross_entropy(F.col("logits"), F.col("label")), 6).alias("ce"))


def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dimension_stats(_t(spark, sf_dir, "embeddings"), "embedding").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def mean_by_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_by_steps(_t(spark, sf_dir, "events"), "event_id", "value", 100).select("window", F.round("mean_loss", 4).alias("mean_loss"), "n")


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") / 50).cast("int").alias("y"), (F.col("o_orderkey") % 50).cast("int").alias("x"), image.in_range(F.col("o_totalprice"), 0, 20000).alias("v")).dropDuplicates(["y", "x"])
    return image.spread(grid, image.box(3, 5), "v", True)


KERNEL = ["10111", "11101", "01111"]


def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") / 50).cast("int").alias("y"), (F.col("o_orderkey") % 50).cast("int").alias("x"), F.col("o_totalprice").alias("v"))
    grid = rows.groupBy("y", "x").agg(image.in_range(F.max("v"), 2000, 10**9).alias("v"))
    return image.spread_times(grid, image.kernel(KERNEL), "v", False, 2)


def global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 150)


def row_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.located(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "local", "place")


def file_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sampling.file_index(_t(spark, sf_dir, "documents"), "source")
    return sampling.file_of_place(_t(spark, sf_dir, "orders").select("o_orderkey"), index, "o_orderkey", "source", block=64).select("o_orderkey", "source", "local")


def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stride(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8, seed=3).select("o_orderkey", "worker")


def move_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.move_names(spark).groupBy("kind").agg(F.countDistinct("move").alias("n"), F.min("move").alias("first_move"), F.max("move").alias("last_move"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    known = part.where("p_size <= 25").agg(F.array_sort(F.collect_set("p_brand")).alias("w")).select(F.posexplode("w").alias("id", "token"))
    rows = part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("text"))
    return vocabulary.token_ids(rows, "p_partkey", "text", known).select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


#: Positions made up for the queries: board, then the rest from a row's numbers.
BOARDS = ("8/2k5/8/3pP3/8/8/5K2/8", "r3k2r/8/8/8/8/8/8/R3K2R", "8/8/8/8/8/8/8/8")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for each order, and one after it for two orders of three."""
    k = F.col("o_orderkey")
    board = F.element_at(F.array(*map(F.lit, BOARDS)), (k % 3 + 1).cast("int"))
    rest = F.concat(F.when(k % 2 == 0, " w ").otherwise(" b "), F.when(k % 5 == 0, "-").otherwise("KQkq"), F.when(k % 7 == 0, " e3 ").otherwise(" - "))
    fen = F.concat(board, rest, (k % 130).cast("string"), F.lit(" "), (k % 1300).cast("string"))
    later = F.when(k % 3 != 0, F.concat(F.lit(" 8/8/8/8/8/8/8/8 b - -  0 "), (k % 90 + 1).cast("string")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", fen.alias("fen"), later.alias("next_fen"))


def fixed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("o_orderkey", scalars.fixed_fen(F.col("fen")).alias("fixed"))


def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ranking.summary(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score", 30)
    listed = F.transform("top", lambda m: F.struct(F.concat(F.lit("m"), m["l_linenumber"].cast("string")).alias("move"), m["score"].alias("win_prob")))
    rows = _positions(spark, sf_dir).join(ranks.select(F.col("l_orderkey").alias("o_orderkey"), listed.alias("moves")), "o_orderkey")
    rows = rows.withColumn("top_n", examples.chosen(F.col("o_orderkey"), list(vocabulary.LENGTHS), 5))
    return examples.texts(rows, "o_orderkey", "fen", "moves", "top_n", "next_fen", seed=9).select("o_orderkey", "top_n", "prompt", "answer")


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.array(F.col("o_orderkey") % 97, F.col("o_custkey") % 97)
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), prompt.alias("prompt_ids"))
    items = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("i"))
    rows = orders.join(items.select("l_orderkey", F.transform("i", lambda x: x["l_partkey"] % 97).alias("answer_ids")), "l_orderkey")
    return examples.token_rows(rows, "prompt_ids", "answer_ids", 6, 40, 70)


def training_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _token_rows(spark, sf_dir).select("l_orderkey", text("input_ids"), text("attention_mask"), text("labels"), text("value_token_mask"))


def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _token_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("l_orderkey") / 64))
    out = examples.batch_statistics(rows, "batch")
    return out.select("batch", "masked", "trained", F.round("percent_masked", 6).alias("percent_masked"), F.round("percent_trained", 6).alias("percent_trained"), "value_tokens")


def row_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", examples.chosen(F.col("o_orderkey"), list(vocabulary.LENGTHS), 4).alias("top_n"))


def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each index, as a list may be as long as the table: its place in the list of its choice."""
    rows = row_choice(spark, sf_dir)
    return sampling.ranked_in_group(rows, "top_n", "o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), 17)


def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return examples.shuffled_batches(rows, "o_orderpriority", "o_orderkey", 16, seed=2, epoch=1)


def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.first_groups(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 10)


def planned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.select("o_orderpriority", examples.planned_steps(F.col("n"), 2, 8, 3).alias("steps"), examples.pad_id(F.nullif(F.col("n") % 2, F.lit(1))).alias("pad_id"))


def shard_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.shard_slice(spark, sf_dir, "3-7", "*.parquet").select("number", F.element_at(F.split("path", "/"), -1).alias("file"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    return rows.select("c_custkey", rendering.jsonl(["c_custkey", "c_name", "segment"]).alias("line"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ranking.summary(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score", 30)
    every = F.transform("top", lambda m: F.struct(F.concat(F.lit("m"), m["l_linenumber"].cast("string")).alias("move"), m["score"].alias("win_prob")))
    rows = _positions(spark, sf_dir).join(ranks.select(F.col("l_orderkey").alias("o_orderkey"), "n_items", every.alias("moves")), "o_orderkey")
    missing = F.transform(F.sequence(F.col("n_items").cast("int") + 1, F.lit(7)), lambda i: F.concat(F.lit("m"), i.cast("string")))
    missing = F.when(F.col("n_items") < 7, missing).otherwise(F.array().cast("array<string>"))
    block = rendering.text_block(F.col("fen"), F.col("n_items"), F.slice("moves", 1, 5), F.col("moves"), F.get("moves", F.lit(0))["move"], F.col("next_fen"), F.col("n_items") >= 7, missing, F.array().cast("array<string>"))
    return rows.select("o_orderkey", block.alias("block"))


def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", scalars.rounded(F.col("value") / 7, 4).alias("rounded"), scalars.rounded(F.floor("value") / 16, 3).alias("tied"))


#: A position, a move in it, how many moves are legal there and the position after the move, all well known or worked out by hand.
PLAYED = (
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "g1f3", 20, "rnbqkbnr/pppppppp/8/8/8/5N2/PPPPPPPP/RNBQKB1R b KQkq - 1 1"),
    ("8/8/8/8/8/8/8/K1k5 w - - 0 1", "a1a2", 1, "8/8/8/8/8/8/K7/2k5 b - - 1 1"),
    ("8/P6k/8/8/8/8/8/K7 w - - 0 1", "a7a8q", 7, "Q7/7k/8/8/8/8/8/K7 b - - 0 1"),
    ("4k3/8/8/8/8/8/8/4K2R w K - 0 1", "e1g1", 15, "4k3/8/8/8/8/8/8/5RK1 b - - 1 1"),
    ("7k/8/8/8/8/8/8/K7 b - - 3 9", "h8h1", 3, None),
)


def positions_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([p[:2] for p in PLAYED], "fen string, move string")
    return rows.select("fen", "move", F.size(moves.legal_moves("fen")).alias("n_moves"), moves.play("fen", "move").alias("next_fen"))


def vocabulary_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = vocabulary.move_names(spark).select("move").distinct()
    listed = names.select("move", (F.row_number().over(W.orderBy("move")) - 1).alias("idx"))  # some 2,000 rows
    table = vocabulary.extended(spark, listed, 100)
    return table.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("token").alias("n_tokens"))


def bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ranking.summary(_order_items(spark, sf_dir), "l_orderkey", "l_linenumber", "score")
    tie, losing = ranking.value_flags(F.col("top"), "score", 5, 0.5, 0.3)
    keys = ranks.select((F.col("l_orderkey") % 30).alias("bucket"), (F.col("l_orderkey") % 4).alias("file"), "n_items", (F.col("n_items") >= 6).alias("complete"), tie.alias("tiebreak"), losing.alias("losing"), (F.col("best") == 2).alias("agrees"))
    flags = ["complete", "tiebreak", "losing", "agrees"]
    return validation.bucket_totals(validation.bucket_statistics(keys, "bucket", "file", "n_items", flags), flags)


#: The kernels of the segmentation, and how often the second is applied. What isn't 0 counts.
OPENING = (10, 10)
CLOSING = ["11110111111", "11121111111", "11101011111", "11101011211", "11111011111", "11111001111", "11111111111"]
TIMES = 4


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, dilation, erosion four times, NOT, AND and the marked pixel, on a picture 100 wide."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").where("o_orderkey < 3000").select((k / 100).cast("int").alias("y"), (k % 100).cast("int").alias("x"), (F.col("o_totalprice") % 256).cast("int").alias("p"))
    grid = rows.groupBy("y", "x").agg(F.max("p").alias("p")).withColumn("t", image.in_range(F.col("p"), 0, 40))
    opened = image.spread(grid.select("y", "x", F.col("t").alias("v")), image.box(*OPENING), "v", True)
    closed = image.spread_times(opened, image.kernel(CLOSING), "v", False, TIMES)
    mask = image.both(image.inverted(F.col("t")), F.col("v"))
    out = grid.join(closed, ["y", "x"]).withColumn("mask", image.both(mask, image.inverted(F.col("t"))))
    return out.select("y", "x", "mask", F.array_join(image.marked(F.col("mask"), F.array("p", "p", "p")).cast("array<string>"), ",").alias("colour"))


_RANKED = """
WITH best AS (SELECT {key}, {item}, max(l_discount * 10) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {item}) AS rn FROM best)
"""
_BUCKET = "least(CAST(floor(greatest(0.0, least(1.0, {v})) * 63 + 0.5) AS INT), 63)"
_ORDERS = _RANKED.format(key="l_orderkey", item="l_linenumber")
_SUMMARY = "SELECT {key}, count(*) AS n_items, max({item}) FILTER (rn = 1) AS best, string_agg({item} || ':<val_' || " + _BUCKET.format(v="score") + " || '>', ' ' ORDER BY rn) FILTER (rn <= 5) AS top5 FROM r GROUP BY {key}"
_PLACE = "row_number() OVER (ORDER BY md5(o_orderkey || ':{seed}'), o_orderkey) - 1"

_BOARD = "['" + "', '".join(BOARDS) + "'][o_orderkey % 3 + 1]"
_DOTS = "replace({b}, '/', '')"
for _n in range(1, 9):
    _DOTS = f"replace({_DOTS}, '{_n}', '{'.' * _n}')"
_FEN = _BOARD + " || CASE WHEN o_orderkey % 2 = 0 THEN ' w ' ELSE ' b ' END || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE 'KQkq' END || CASE WHEN o_orderkey % 7 = 0 THEN ' e3 ' ELSE ' - ' END || o_orderkey % 130 || ' ' || o_orderkey % 1300"
_LEFT = "lpad({v}, CAST(greatest(length({v}), {n}) AS INT), '.')"
_FIXED = _DOTS.format(b=_BOARD) + " || CASE WHEN o_orderkey % 2 = 0 THEN ' w ' ELSE ' b ' END || CASE WHEN o_orderkey % 5 = 0 THEN '....' ELSE 'KQkq' END || CASE WHEN o_orderkey % 7 = 0 THEN ' e3 ' ELSE ' -. ' END || " + _LEFT.format(v="CAST(o_orderkey % 130 AS VARCHAR)", n=2) + " || ' ' || " + _LEFT.format(v="CAST(o_orderkey % 1300 AS VARCHAR)", n=3)
_AFTER = "CASE WHEN o_orderkey % 3 <> 0 THEN ' 8/8/8/8/8/8/8/8 b - -  0 ' || (o_orderkey % 90 + 1) END"
_AFTER_FIXED = "CASE WHEN o_orderkey % 3 <> 0 THEN repeat('.', 64) || ' b .... -. .0 ' || " + _LEFT.format(v="CAST(o_orderkey % 90 + 1 AS VARCHAR)", n=3) + " END"
_CHOICE = "CAST([3, 5, 10, 20, 30][CAST(('0x' || substr(md5(o_orderkey || ':{seed}'), 1, 8))::UBIGINT % 5 + 1 AS INT)] AS INT)"
_TOKENS = """t AS (SELECT l_orderkey, list(l_partkey % 97 ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1),
    e AS (SELECT l_orderkey, list_concat([o_orderkey % 97, o_custkey % 97], a)[1:6] AS ids, list_concat([-100, -100], a)[1:6] AS labels FROM t JOIN orders ON l_orderkey = o_orderkey)"""
_KERNEL_ROWS = ", ".join(f"({y - len(CLOSING) // 2}, {x - len(row) // 2})" for y, row in enumerate(CLOSING) for x, cell in enumerate(row) if cell != "0")

#: name -> SQL
ORACLES: dict[str, str] = {
    "fixed_positions": f"SELECT o_orderkey, {_FIXED} AS fixed FROM orders",
    "training_texts": _ORDERS + f""", o AS (SELECT o_orderkey, {_CHOICE.format(seed=5)} AS top_n, {_FIXED} AS f, {_AFTER_FIXED} AS g FROM orders)
        SELECT o_orderkey, top_n, '<|chess|> %prev_FEN %top_' || top_n || ' %best_action %FEN' || chr(10) || '[%prev_FEN ' || f || ']' AS prompt,
        chr(10) || '[%top_' || top_n || ' ' || string_agg('m' || l_linenumber || ':<val_' || {_BUCKET.format(v="score")} || '>', ' ' ORDER BY md5(o_orderkey || ':m' || l_linenumber || ':9')) FILTER (rn <= top_n) || ']' || chr(10) || '[%best_action m' || max(l_linenumber) FILTER (rn = 1) || ']' || coalesce(chr(10) || '[%FEN ' || g || ']', '') AS answer
        FROM r JOIN o ON l_orderkey = o_orderkey GROUP BY o_orderkey, top_n, f, g""",
    "training_tokens": f"""WITH {_TOKENS} SELECT l_orderkey, array_to_string(ids, ',') AS input_ids, array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask, array_to_string(labels, ',') AS labels,
        array_to_string(list_transform(ids, lambda x: CASE WHEN x >= 40 AND x < 70 THEN 'true' ELSE 'false' END), ',') AS value_token_mask FROM e""",
    "batch_statistics": f"""WITH {_TOKENS}, c AS (SELECT l_orderkey // 64 AS batch, max(len(labels)) * count(*) AS cells, sum(len(list_filter(labels, lambda x: x <> -100))) AS trained, sum(len(list_filter(ids, lambda x: x >= 40 AND x < 70))) AS value_tokens FROM e GROUP BY 1)
        SELECT batch, CAST(cells - trained AS BIGINT) AS masked, CAST(trained AS BIGINT) AS trained, round(100.0::DOUBLE * (cells - trained) / cells, 6) AS percent_masked, round(100.0::DOUBLE * trained / cells, 6) AS percent_trained, CAST(value_tokens AS BIGINT) AS value_tokens FROM c""",
    "row_choice": f"SELECT o_orderkey, {_CHOICE.format(seed=4)} AS top_n FROM orders",
    "index_lists": f"WITH c AS (SELECT o_orderkey, {_CHOICE.format(seed=4)} AS top_n FROM orders) SELECT o_orderkey, top_n, row_number() OVER (PARTITION BY top_n ORDER BY o_orderkey) - 1 AS place FROM c",
    "shuffled_batches": """WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || ':2.1'), o_orderkey) - 1 AS r FROM orders),
        n AS (SELECT DISTINCT o_orderpriority, r // 16 AS b, o_orderpriority || ':' || r // 16 || ':2.1' AS name FROM p), o AS (SELECT *, row_number() OVER (ORDER BY md5(name || ':2'), name) - 1 AS batch FROM n)
        SELECT o_orderkey, p.o_orderpriority, batch, r % 16 AS place FROM p JOIN o ON p.o_orderpriority = o.o_orderpriority AND r // 16 = b""",
    "first_groups": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 10)",
    "planned_steps": "SELECT o_orderpriority, count(*) // 16 * 3 AS steps, CAST(0 AS BIGINT) AS pad_id FROM orders GROUP BY 1",
    "shard_slice": "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS number, t || '.parquet' AS file FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) v(t)) WHERE number >= 3 AND number < 7",
    "json_lines": "SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'segment': CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END}) AS VARCHAR) AS line FROM customer",
    "text_blocks": _ORDERS + f""", o AS (SELECT o_orderkey, {_FEN} AS f, {_AFTER} AS g FROM orders),
        l AS (SELECT l_orderkey, count(*) AS n, string_agg('m' || l_linenumber || ':' || format('{{:.3f}}', score), ' ' ORDER BY rn) AS every, string_agg('m' || l_linenumber || ':' || format('{{:.3f}}', score), ' ' ORDER BY rn) FILTER (rn <= 5) AS five, max(l_linenumber) FILTER (rn = 1) AS best FROM r GROUP BY 1)
        SELECT o_orderkey, 'FEN: ' || f || chr(10) || 'LEGAL_MOVES: ' || n || chr(10) || 'TOP5: ' || five || chr(10) || 'ALL_MOVES: ' || every || chr(10) || 'BEST: m' || best || chr(10) || 'NEXT_FEN: ' || coalesce(g, '') || chr(10) || 'COMPLETE: ' || CASE WHEN n >= 7 THEN 'true' ELSE 'false' END
        || CASE WHEN n < 7 THEN chr(10) || 'MISSING: ' || array_to_string(list_transform(range(n + 1, 8), lambda i: 'm' || i), ' ') ELSE '' END || chr(10) || '---' AS block FROM l JOIN o ON l_orderkey = o_orderkey""",
    "rounded_values": "SELECT event_id, CAST(format('{:.4f}', value / 7) AS DOUBLE) AS rounded, CAST(format('{:.3f}', floor(value) / 16) AS DOUBLE) AS tied FROM events",
    "positions_played": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({n} AS INT), {repr(c) if c else 'NULL'})" for a, b, n, c in PLAYED) + ") v(fen, move, n_moves, next_fen)",
    "vocabulary_layout": """WITH q AS (SELECT abs(s % 8 - t % 8) AS dx, abs(s // 8 - t // 8) AS dy, s // 8 AS a, t // 8 AS b FROM range(64) x(s), range(64) y(t) WHERE s <> t),
        n AS (SELECT count(*) FILTER (dx = 0 OR dy = 0 OR dx = dy OR dx * dy = 2) + 4 * count(*) FILTER (dx <= 1 AND (a = 6 AND b = 7 OR a = 1 AND b = 0)) AS moves FROM q)
        SELECT kind, n, first_id, first_id + n - 1 AS last_id, n AS n_tokens FROM (SELECT 'marker' AS kind, 9::BIGINT AS n, 100::BIGINT AS first_id UNION ALL SELECT 'value', 64, 109 UNION ALL SELECT 'move', moves, 173 FROM n)""",
    "bucket_totals": _ORDERS + """, k AS (SELECT l_orderkey, count(*) AS n, count(*) >= 5 AND min(score) FILTER (rn <= 5) > 0.5 AS tiebreak, count(*) >= 5 AND max(score) FILTER (rn <= 5) < 0.3 AS losing, max(l_linenumber) FILTER (rn = 1) = 2 AS agrees FROM r GROUP BY 1)
        SELECT count(DISTINCT l_orderkey % 30) AS buckets, (SELECT count(DISTINCT (l_orderkey % 30, l_orderkey % 4)) FROM k) AS files, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_items, count(*) FILTER (n >= 6) AS n_complete, count(*) FILTER (tiebreak) AS n_tiebreak, count(*) FILTER (losing) AS n_losing, count(*) FILTER (agrees) AS n_agrees,
        100.0::DOUBLE * count(*) FILTER (n >= 6) / count(*) AS percent_complete, 100.0::DOUBLE * count(*) FILTER (tiebreak) / count(*) AS percent_tiebreak, 100.0::DOUBLE * count(*) FILTER (losing) / count(*) AS percent_losing, 100.0::DOUBLE * count(*) FILTER (agrees) / count(*) AS percent_agrees FROM k""",
    "segmentation": f"""WITH g AS (SELECT CAST(o_orderkey // 100 AS INT) AS y, CAST(o_orderkey % 100 AS INT) AS x, CAST(max(CAST(floor(o_totalprice % 256) AS INT)) AS INT) AS p FROM orders WHERE o_orderkey < 3000 GROUP BY 1, 2),
        t AS (SELECT *, CASE WHEN p BETWEEN 0 AND 40 THEN 255 ELSE 0 END AS t FROM g),
        c(dy, dx) AS (VALUES {_KERNEL_ROWS}),
        e0 AS (SELECT a.y, a.x, max(b.t) AS v FROM t a JOIN t b ON b.y BETWEEN a.y - {OPENING[0] // 2} AND a.y + {OPENING[0] - OPENING[0] // 2 - 1} AND b.x BETWEEN a.x - {OPENING[1] // 2} AND a.x + {OPENING[1] - OPENING[1] // 2 - 1} GROUP BY 1, 2),
        """ + ", ".join(f"e{i + 1} AS (SELECT a.y, a.x, min(b.v) AS v FROM e{i} a, c JOIN e{i} b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2)" for i in range(TIMES)) + f"""
        SELECT t.y, t.x, CASE WHEN t.t = 0 AND v = 255 THEN 255 ELSE 0 END AS mask, CASE WHEN t.t = 0 AND v = 255 THEN '0,255,0' ELSE p || ',' || p || ',' || p END AS colour FROM t JOIN e{TIMES} USING (y, x)""",
    "rank_by_key": _ORDERS + _SUMMARY.format(key="l_orderkey", item="l_linenumber"),
    "rank_large_groups": _RANKED.format(key="l_suppkey", item="l_partkey") + _SUMMARY.format(key="l_suppkey", item="l_partkey"),
    "rank_of_item": _ORDERS + "SELECT l_orderkey, max(rn) FILTER (l_linenumber = 2 AND rn <= 5) AS rank_of_2, max(l_linenumber) FILTER (rn = 1) = 2 AS agrees FROM r GROUP BY l_orderkey",
    "value_flags": _ORDERS + """, f AS (SELECT l_orderkey, count(*) >= 5 AND min(score) FILTER (rn <= 5) > 0.5 AS tiebreak, count(*) >= 5 AND max(score) FILTER (rn <= 5) < 0.3 AS losing FROM r GROUP BY l_orderkey)
        SELECT count(*) AS groups, count(*) FILTER (tiebreak) AS n_tiebreak, count(*) FILTER (losing) AS n_losing, count(*) FILTER (tiebreak) * 100.0::DOUBLE / count(*) AS percent_tiebreak, count(*) FILTER (losing) * 100.0::DOUBLE / count(*) AS percent_losing FROM f""",
    "bucket_counts": "SELECT CAST(('0x' || substr(md5(text), 1, 8))::UBIGINT % 1000 AS INT) AS bucket_id, count(*) AS n_rows, count(DISTINCT text) AS n_keys FROM documents GROUP BY 1",
    "missing_items": "SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 100",
    "completeness": """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), k AS (SELECT DISTINCT l_orderkey FROM d), e AS (SELECT l_orderkey, unnest(range(1, 7)) AS l_linenumber FROM k),
        b AS (SELECT coalesce(d.l_orderkey, e.l_orderkey) AS l_orderkey, d.l_orderkey IS NULL AS m, e.l_orderkey IS NULL AS x FROM d FULL JOIN e ON d.l_orderkey = e.l_orderkey AND d.l_linenumber = e.l_linenumber)
        SELECT l_orderkey, count(*) FILTER (m) AS n_missing, count(*) FILTER (x) AS n_extra, count(*) FILTER (m OR x) = 0 AS is_complete FROM b GROUP BY 1""",
    "run_statistics": "WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey % 30 AS bucket_id, count(*) AS n_keys, count(*) FILTER (n >= 6) AS n_complete, CAST(sum(n) AS BIGINT) AS n_items, round(count(*) FILTER (n >= 6) * 100.0::DOUBLE / count(*), 6) AS percent_complete FROM g GROUP BY 1",
    "value_buckets": "SELECT " + _BUCKET.format(v="value / 250") + " AS bucket, '<val_' || " + _BUCKET.format(v="value / 250") + " || '>' AS token, count(*) AS n FROM events GROUP BY 1, 2",
    "vocabulary_lookup": "WITH v AS (SELECT DISTINCT p_type FROM part WHERE p_size <= 2) SELECT p_partkey, CASE WHEN v.p_type IS NULL THEN '<m_' || part.p_type || '>' ELSE part.p_type END AS token, v.p_type IS NULL AS is_oov FROM part LEFT JOIN v ON part.p_type = v.p_type",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE list_contains(json_keys(props), 'k')",
    "balanced_choice": "WITH p AS (SELECT o_orderkey, " + _PLACE.format(seed=0) + " AS place FROM orders) SELECT o_orderkey, CAST([3, 5, 10, 20, 30][place % 5 + 1] AS INT) AS top_n FROM p",
    "exact_split": "WITH p AS (SELECT o_orderkey, " + _PLACE.format(seed=1) + " AS place FROM orders) SELECT o_orderkey, place < CAST(floor((SELECT count(*) FROM orders) * 0.05::DOUBLE) AS BIGINT) AS is_eval FROM p",
    "batches": "WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority, r // 16 AS batch, r % 16 AS place FROM p WHERE r // 16 < n // 16",
    "batch_counts": "SELECT o_orderpriority, count(*) AS n_rows, (count(*) + 15) // 16 AS batches, count(*) // 16 AS full_batches FROM orders GROUP BY 1",
    "first_per_group": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
    "file_index": "SELECT source, count(*) AS n_rows, CAST(coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row FROM documents GROUP BY source",
    "padded_lengths": "WITH s AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, len(list_filter(string_split(text, ' '), lambda w: w = '')) AS e FROM conversations), m AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS padded FROM s) SELECT conv_id, turn, padded, padded - n + e AS zeros FROM m",
    "length_stats": "SELECT CAST(min(len(string_split(text, ' '))) AS INT) AS shortest, CAST(max(len(string_split(text, ' '))) AS INT) AS longest, round(avg(len(string_split(text, ' '))), 1) AS mean_length FROM conversations",
    "next_token": "SELECT event_id, target FROM (SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events) WHERE target IS NOT NULL",
    "cross_entropy": "SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))) + list_max(embedding)::DOUBLE - embedding[label + 1]::DOUBLE, 6) AS ce FROM embeddings",
    "dimension_stats": "SELECT CAST(i AS INT) AS dim, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean, round(stddev_samp(embedding[i + 1]::DOUBLE), 6) AS std FROM embeddings, range(64) t(i) GROUP BY i",
    "mean_by_steps": "SELECT event_id // 100 AS window, round(avg(value), 4) AS mean_loss, count(*) AS n FROM events GROUP BY 1",
    "dilate": """WITH g AS (SELECT DISTINCT CAST(o_orderkey // 50 AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x, CASE WHEN o_totalprice BETWEEN 0 AND 20000 THEN 255 ELSE 0 END AS v FROM orders),
        n AS (SELECT y + dy AS y, x + dx AS x, v FROM g, range(-1, 2) r(dy), range(-2, 3) c(dx))
        SELECT g.y, g.x, max(n.v) AS v FROM g JOIN n ON n.y = g.y AND n.x = g.x GROUP BY 1, 2""",
    "erode": """WITH g AS (SELECT CAST(o_orderkey // 50 AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x, CASE WHEN max(o_totalprice) BETWEEN 2000 AND 1000000000 THEN 255 ELSE 0 END AS v FROM orders GROUP BY 1, 2),
        k(dy, dx) AS (VALUES (-1, -2), (-1, 0), (-1, 1), (-1, 2), (0, -2), (0, -1), (0, 0), (0, 2), (1, -1), (1, 0), (1, 1), (1, 2)),
        e AS (SELECT g.y, g.x, min(n.v) AS v FROM g, k JOIN g n ON n.y = g.y + dy AND n.x = g.x + dx GROUP BY 1, 2)
        SELECT e.y, e.x, min(n.v) AS v FROM e, k JOIN e n ON n.y = e.y + dy AND n.x = e.x + dx GROUP BY 1, 2""",
    "global_cap": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY source, doc_id) <= 150",
    "row_places": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS local, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents",
    "file_of_place": "WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS local, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents) SELECT o_orderkey, source, local FROM orders JOIN p ON o_orderkey = place",
    "stride": "WITH p AS (SELECT o_orderkey, " + _PLACE.format(seed=3) + " AS place FROM orders) SELECT o_orderkey, CAST(place % 8 AS INT) AS worker FROM p",
    "move_kinds": """WITH q AS (SELECT s, t, abs(s % 8 - t % 8) AS dx, abs(s // 8 - t // 8) AS dy, chr(CAST(97 + s % 8 AS INT)) || (s // 8 + 1) || chr(CAST(97 + t % 8 AS INT)) || (t // 8 + 1) AS m FROM range(64) a(s), range(64) b(t)),
        k AS (SELECT CASE WHEN dx = 0 OR dy = 0 OR dx = dy THEN 'line' ELSE 'leap' END AS kind, m FROM q WHERE s <> t AND (dx = 0 OR dy = 0 OR dx = dy OR dx * dy = 2)
        UNION ALL SELECT 'promotion', m || p FROM q, (VALUES ('q'), ('r'), ('b'), ('n')) v(p) WHERE dx <= 1 AND (s // 8 = 6 AND t // 8 = 7 OR s // 8 = 1 AND t // 8 = 0))
        SELECT kind, count(DISTINCT m) AS n, min(m) AS first_move, max(m) AS last_move FROM k GROUP BY kind""",
    "token_ids": """WITH v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT p_brand AS token FROM part WHERE p_size <= 25)),
        w AS (SELECT p_partkey, 0 AS place, p_brand AS token FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part)
        SELECT p_partkey, string_agg(CAST(coalesce(v.id, -1) AS VARCHAR), ',' ORDER BY place) AS ids FROM w LEFT JOIN v USING (token) GROUP BY 1""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLES}
