"""Reading shards, JSON items and vocabularies; writing buckets and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import hash_bucket

ITEM = "fen string, moves array<array<string>>, best_action string, next_fen string, _corrupt_record string"
REQUIRED = ("fen", "moves", "best_action")


def parse_range(text: str) -> tuple[int, int]:
    start, end = text.split("-")
    return int(start), int(end)


def listed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and 0-based number of each file of a folder, in name order; the bytes are not read.

    A folder in it whose name matches is one entry, as Spark writes a table as a folder of parts. As in Spark's
    own listing, names that begin with a dot or an underscore and empty files don't count.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    name = hadoop.Path(folder)
    system = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listStatus(name, hadoop.GlobFilter(pattern))
    paths = sorted(str(x.getPath()) for x in found if x.getPath().getName()[0] not in "._" and (x.isDirectory() or x.getLen()))
    if not paths:
        raise FileNotFoundError(f"no file in {folder} matches {pattern}")
    return spark.createDataFrame(list(enumerate(paths)), "number int, path string")


def shard_slice(spark: SparkSession, folder: str, shards: str, pattern: str = "*") -> DataFrame:
    """Those of the listed files whose numbers are in a range such as 0-500, its end exclusive."""
    start, end = parse_range(shards)
    return listed_files(spark, folder, pattern).where((F.col("number") >= start) & (F.col("number") < end))


def first_character(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first character of each file that is no white space, from its first bytes."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for path in paths:
        name = jvm.org.apache.hadoop.fs.Path(path)
        stream = name.getFileSystem(conf).open(name)
        try:
            while (byte := stream.read()) in (9, 10, 13, 32, 0xEF, 0xBB, 0xBF):
                pass
            found[path] = chr(byte) if byte >= 0 else ""
        finally:
            stream.close()
    return found


def json_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of .json and .jsonl files, by what a file starts with: one array, or an object a line. Rows without a required key and malformed ones go."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,jsonl}").load(folder).select("path")
    kinds = {True: [], False: []}
    for path, first in first_character(spark, sorted({r["path"] for r in files.collect()})).items():  # a row for each file
        kinds[first == "["].append(path)
    if not any(kinds.values()):
        raise FileNotFoundError(f"no JSON file in {folder}")
    parts = []
    if kinds[False]:
        parts.append(spark.read.text(kinds[False]).select("value"))
    if kinds[True]:
        whole = spark.read.text(kinds[True], wholetext=True)
        parts.append(whole.select(F.explode(F.from_json("value", "array<string>")).alias("value")))
    items = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    keys = F.size(F.array_intersect(F.json_object_keys("value"), F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED)
    out = items.where(keys).select(F.from_json("value", ITEM, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*").where("_corrupt_record is null")
    return out.drop("_corrupt_record").withColumn("moves", F.transform("moves", lambda m: F.struct(m[0].alias("move"), m[1].cast("double").alias("win_prob"))))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """idx and move of a file with one move a line; read as one text, so the order is the file's."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("idx", "move"))


def write_buckets(rows: DataFrame, key: str, path: str, buckets: int, compress: bool = True) -> None:
    """Parquet partitioned by bucket_id; all rows of a key are in one bucket. One shuffle, committed as a whole."""
    out = rows.withColumn("bucket_id", hash_bucket(F.col(key), buckets)).repartition("bucket_id")
    out.write.partitionBy("bucket_id").option("compression", "zstd" if compress else "uncompressed").parquet(path)


def read_bucket(spark: SparkSession, path: str, bucket: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("bucket_id") == bucket)


def write_bucket_files(lines: DataFrame, bucket: str, line: str, path: str, suffix: str = "jsonl") -> list[str]:
    """One text file bucket_00000.suffix for each bucket, of its rows' lines; returns the names.

    Spark writes a folder for each bucket; its one part is then renamed, which on a file system with renames moves no bytes.
    """
    spark = lines.sparkSession
    staged = f"{path}/_staged"
    lines.select(F.col(bucket).alias("bucket_id"), F.col(line).alias("value")).repartition("bucket_id").write.partitionBy("bucket_id").mode("overwrite").text(staged)
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path
    system = name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = []
    for part in system.globStatus(name(f"{staged}/bucket_id=*/part-*")) or []:
        number = int(part.getPath().getParent().getName().split("=")[1])
        made.append(f"bucket_{number:05d}.{suffix}")
        target = name(f"{path}/{made[-1]}")
        system.delete(target, False)
        if not system.rename(part.getPath(), target):
            raise OSError(f"{part.getPath()} can't be renamed to {target}")
    system.delete(name(staged), True)
    return sorted(made)


def merge_buckets(spark: SparkSession, partials: list[str], path: str) -> None:
    """Buckets written by several workers (write_buckets each) as one table, a file for each bucket."""
    rows = spark.read.parquet(partials[0])
    for other in partials[1:]:
        rows = rows.unionByName(spark.read.parquet(other))
    rows.repartition("bucket_id").write.partitionBy("bucket_id").parquet(path)


def delete_after(spark: SparkSession, paths: list[str], done: str) -> int:
    """Deletes inputs once the job that read them has committed (its _SUCCESS is in ``done``); else none. Returns how many went."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not name(done).getFileSystem(conf).exists(name(f"{done}/_SUCCESS")):
        return 0
    return sum(name(p).getFileSystem(conf).delete(name(p), True) for p in paths)


def progress(done: int, seconds: float, total: int | None = None) -> dict[str, float | None]:
    """Rows a second (0 at no time), and the seconds left where the total is known and there is a rate."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"done": done, "rate": rate, "left": (total - done) / rate if total is not None and rate else None}
