"""Token-id files: per-document zstandard frames under one shared dictionary, in ascending document order.

Layout of a written folder (Parquet, so that any file system Spark knows can hold it and its commit protocol covers
lost executors):

* ``dictionary`` - one row: the zstandard dictionary, its SHA-256, the item type of the ids;
* ``blocks`` - a row per block of about one MiB: part and number in the part, the dictionary's SHA-256, the documents'
  ids, token counts and byte offsets, and the payload, in which each document is a frame of its own.

A short document is read by its block's id range, its offset and one small frame (``read_documents``).

Edge cases: a null text is empty (only the end id); null document ids come first; repeated document ids are kept, in
the order of a hash of their texts; an empty table gives empty files; a long text is one frame; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.tokens import Encoder

SAMPLE_DOCS = 512  # documents that train the dictionary, at most
SAMPLE_CHARS = 32_768  # longer ones do not train it
DICTIONARY_BYTES = 32_768
BLOCK_BYTES = 1 << 20
LEVEL = 3


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary from a bounded sample: of the SAMPLE_DOCS documents with the least hashes of their id, those of 1 to SAMPLE_CHARS characters.

    It only bears on the files' size; reading takes the dictionary that was written, and checks its hash.
    """
    at = F.xxhash64("doc_id")
    least = docs.where("doc_id is not null").select(at.alias("at")).orderBy("at").limit(SAMPLE_DOCS).collect()  # ids alone are read
    few = docs.where(F.col("doc_id").isNotNull() & (at <= (least[-1]["at"] if least else 0)) & F.length("text").between(1, SAMPLE_CHARS))
    sample = few.select("text", at.alias("at")).orderBy("at", F.xxhash64("text")).limit(SAMPLE_DOCS).collect()
    encode = Encoder.at(tokenizer)
    pieces = [x for row in sample if (x := encode(row["text"]).tobytes())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples: their bytes serve as they are
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2) -> None:
    """Encode every whole text and write the files in ascending doc_id order."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(raw).hexdigest()
    dtype = Encoder.at(tokenizer).dtype.str
    spark.createDataFrame([(digest, raw, dtype)], "sha256 string, dictionary binary, item string").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)

    def blocks(batches):
        encode, packer = Encoder.at(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        end = np.array([] if end_id is None else [end_id], encode.dtype).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        ids, counts, offsets, payload = [], [], [0], []

        def block():
            columns = [[part], [number], [digest], [ids], [counts], [offsets], [b"".join(payload)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc_id, tokens in encode.groups(batch):
                tokens = tokens.tobytes() + end
                payload.append(packer.compress(tokens))
                ids.append(doc_id)
                counts.append(len(tokens) // encode.dtype.itemsize)
                offsets.append(offsets[-1] + len(payload[-1]))
                if offsets[-1] >= BLOCK_BYTES:
                    yield block()
                    number += 1
                    ids, counts, offsets, payload = [], [], [0], []
        if ids:
            yield block()

    # bounds from the ids alone: ranging by repartitionByRange would read the texts once more
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or [] if parts > 1 else []
    part = _place(F.col("doc_id"), bounds)
    ordered = (
        docs.select("doc_id", "text").repartitionById(parts, F.when(F.col("doc_id").isNull(), 0).otherwise(part))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(blocks, "part int, block int, dictionary_sha256 string, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the value, with about twice the root of their number of comparisons."""
    step = max(1, round(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    below = lambda of: F.size(F.filter(of, lambda x: x < value))
    run = below(F.lit([x[0] for x in runs[1:]]).cast("array<bigint>") if len(runs) > 1 else F.array().cast("array<bigint>"))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<bigint>") for x in runs)), run + 1)
    return run * step + below(inside)


_BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def _frames(dictionary, blocks):
    """(doc_id, count, ids as bytes) of each document of the blocks; the dictionary's hash must fit."""
    sha256, raw, item = dictionary
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
    size = np.dtype(item).itemsize
    for doc_ids, counts, offsets, payload, named in blocks:
        if named != sha256:
            raise ValueError(f"block needs dictionary {named}, found {sha256}")
        for doc_id, count, start, end in zip(doc_ids, counts, offsets, offsets[1:], strict=False):
            yield doc_id, count, unpack(payload[start:end], max_output_size=count * size)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and,
    if asked for, the ids in that form.

    Starts come from running sums in each part and over the parts' totals, so no task holds more than a part's index.
    """
    dictionary = tuple(spark.read.parquet(f"{path}/dictionary").first())
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "block", (F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("inside"))
    starts = inside.join(parts, "part").select("part", "block", (F.col("inside") + F.col("before")).alias("first"))
    shared = spark.sparkContext.broadcast(dictionary)
    shape = pa.schema(list(_READ)[: 4 + ids])

    def documents(batches):
        item = np.dtype(shared.value[2])
        for batch in batches:
            for row in batch.to_pylist():
                out, at = [], row["first"]
                for doc_id, count, raw in _frames(shared.value, [(row["doc_ids"], row["counts"], row["offsets"], row["payload"], row["dictionary_sha256"])]):
                    whole = np.frombuffer(raw, item).astype("<u4").tobytes()
                    out.append((doc_id, at, count, zlib.crc32(whole), *([whole] if ids else ())))
                    at += count
                for i in range(0, len(out), 2000):
                    columns = zip(*out[i : i + 2000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, shape.types, strict=True)], schema=shape)

    return blocks.join(starts, ["part", "block"]).select("first", "dictionary_sha256", "doc_ids", "counts", "offsets", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents: only blocks that list them are fetched, and only their frames unpacked."""
    dictionary = tuple(spark.read.parquet(f"{path}/dictionary").first())
    wanted = F.array(*[F.lit(x).cast("long") for x in doc_ids])
    rows = spark.read.parquet(f"{path}/blocks").where(F.arrays_overlap("doc_ids", wanted))
    found = {}
    keep = set(doc_ids)
    for row in rows.toLocalIterator():
        for k, doc_id in enumerate(row["doc_ids"]):
            if doc_id in keep:
                piece = [([doc_id], [row["counts"][k]], row["offsets"][k : k + 2], row["payload"], row["dictionary_sha256"])]
                for _, _, raw in _frames(dictionary, piece):
                    found[doc_id] = np.frombuffer(raw, dictionary[2]).tolist()
    return found
