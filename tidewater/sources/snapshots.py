"""Snapshot exports: bounded reading, per-file and whole hashes, and the splitters of text streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits of a snapshot.
MAX_FILES, MAX_FILE_BYTES, MAX_BYTES = 512, 2 << 20, 16 << 20


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 and ok (the bytes have the hash that the export states) of an export's files."""
    raw = spark.read.schema("version int, commit string, snapshot_hash string, files map<string,struct<sha256:string,bytes:string>>").option("multiLine", True).json(path)
    files = raw.select("commit", "snapshot_hash", F.explode("files").alias("path", "file"))
    content = F.unbase64("file.bytes")
    return files.select("commit", "snapshot_hash", "path", content.alias("content"), F.col("file.sha256").alias("sha256"), (F.sha2(content, 256) == F.col("file.sha256")).alias("ok"))


def snapshot_hash(files: DataFrame, commit: str) -> DataFrame:
    """snapshot_hash: SHA-256 of {"commit":...,"files":{path:sha256,...}} with sorted paths and no spaces."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(F.lit('"'), x["path"], F.lit('":"'), x["sha256"], F.lit('"'))), ",")
    return files.agg(F.sha2(F.concat(F.lit('{"commit":"' + commit + '","files":{'), listed, F.lit("}}")), 256).alias("snapshot_hash"))


def verified(files: DataFrame) -> DataFrame:
    """commit, files, broken (files whose bytes have another hash) and ok of each export: all its files and its whole hash are right.

    Exports are small by their limits, so the paths of one fit into one row.
    """
    entry = F.concat(F.lit('"'), "path", F.lit('":"'), "sha256", F.lit('"'))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))), lambda x: x["entry"]), ",")
    stated = F.sha2(F.concat(F.lit('{"commit":"'), "commit", F.lit('","files":{'), "listed", F.lit("}}")), 256)
    found = files.groupBy("commit", "snapshot_hash").agg(listed.alias("listed"), F.count("*").alias("files"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("broken"))
    return found.select("commit", "files", "broken", F.coalesce((F.col("broken") == 0) & (stated == F.col("snapshot_hash")), F.lit(False)).alias("ok"))


def violations(files: DataFrame) -> DataFrame:
    """Limits that a snapshot breaks: rule and value."""
    total = files.agg(F.count("*").alias("files"), F.max(F.length("content")).alias("largest"), F.sum(F.length("content")).alias("bytes"), (F.count("*") - F.count_distinct("path")).alias("repeated"))
    rules = [("files", MAX_FILES), ("largest", MAX_FILE_BYTES), ("bytes", MAX_BYTES), ("repeated", 0)]
    return total.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("value"), F.lit(m).cast("long").alias("most")) for n, m in rules))).alias("x")).select("x.*").where("value > most")


def events_of(stream: Column) -> Column:
    """array<struct<event, data>> of a server-sent event text; blocks without data are passed over."""
    blocks = F.filter(F.split(stream, r"\r?\n\r?\n"), lambda b: b.rlike(r"(?m)^data:"))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event:\s*(.*)$", 1).alias("event"), F.regexp_extract(b, r"(?m)^data:\s?(.*)$", 1).alias("data")))


def between_headers(texts: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """key, nth, header, body: what lies between matches of a header pattern, without empty bodies."""
    heads, bodies = F.regexp_extract_all(text, F.lit(header), F.lit(0)), F.slice(F.split(text, header, -1), F.lit(2), F.greatest(F.size(F.split(text, header, -1)) - 1, F.lit(0)))
    parts = texts.select(key, F.posexplode(F.arrays_zip(heads.alias("header"), bodies.alias("body"))).alias("nth", "x"))
    return parts.select(key, "nth", F.col("x.header").alias("header"), F.regexp_replace("x.body", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("body")).where("body <> ''")


def nested_samples(df: DataFrame, key: str, sizes: list[int], seed: int) -> DataFrame:
    """key and the smallest of the nested sample sizes that holds it: one seeded order serves all sizes."""
    order = df.select(key, F.xxhash64(F.lit(seed), key).alias("at")).orderBy("at", key).limit(max(sizes))
    numbered = order.withColumn("nth", F.row_number().over(Window.orderBy("at", key)))
    least = F.least(*(F.when(F.col("nth") <= n, F.lit(n)) for n in sizes)) if len(sizes) > 1 else F.lit(sizes[0])
    return numbered.select(key, "nth", least.alias("corpus"))


def frame_indices(total: Column, fps: Column, most: int) -> Column:
    """Evenly spaced frames of a video, about one in three seconds, the last one always among them."""
    count = F.least(F.lit(most), F.greatest(F.lit(1), ((total - 1) / (fps * 3)).cast("int") + 1))
    return F.when(count <= 1, F.array(total - 1)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(i * (total - 1) / (count - 1)).cast("int")))
