"""Knowledge documents: front matter, strict checks, sections as parents and children, bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a line break.
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and content of all files below a folder, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime", "content")


def documents(files: DataFrame, strict: bool = False) -> DataFrame:
    """path, doc_id, meta, content and error of Markdown files with front matter; a bad file has an error and no content.

    strict also rejects pointers of large-file storage, NUL bytes, text that is no UTF-8 and embedded images.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                meta, body, error = None, None, None
                try:
                    text = bytes(raw).decode("utf-8")
                    parts = text.split("---", 2)
                    if strict and (text.startswith("version https://git-lfs") or "\0" in text):
                        raise ValueError("not a text document")
                    if not text.startswith("---") or len(parts) < 3:
                        raise ValueError("no front matter")
                    found = yaml.safe_load(parts[1])
                    if not isinstance(found, dict) or not found.get("scenario"):
                        raise ValueError("front matter without scenario")
                    if strict and any(x in parts[2].lower() for x in ("![", "<img", "<iframe", "<svg")):
                        raise ValueError("embedded media")
                    meta = {str(k): ",".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in found.items() if v is not None}
                    body = parts[2].strip()
                except (ValueError, UnicodeDecodeError, yaml.YAMLError) as e:
                    error = str(e)[:200]
                rows.append((path, meta, body, error))
            yield pd.DataFrame(rows, columns=["path", "meta", "content", "error"])

    found = files.where(F.lower("path").endswith(".md")).select("path", "content").mapInPandas(parse, "path string, meta map<string,string>, content string, error string")
    return found.withColumn("doc_id", F.substring(F.sha2("path", 256), 1, 16))


def _parts(docs: DataFrame, *columns: str, least_intro: int = 60) -> DataFrame:
    """The named columns of docs with seq, chunk_type and text of a whole text: the parent, and the children in order."""
    # a select for each step, so that none is worked out twice
    plain = docs.select(*columns, "content", F.regexp_replace("content", BREAKS, "\n").alias("text"))
    found = plain.select(*columns, "content", F.split("text", r"\n(?=##[ \t][^\n])", -1).alias("found"), F.col("text").rlike(r"\A##[ \t][^\n]").alias("headed"))
    # only the end of the last run of white space is looked for, once for a run
    trimmed = F.transform("found", lambda x: F.regexp_replace(x, r"\A[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++\z", ""))
    kept = F.filter(trimmed, lambda x, i: (x != "") & ((i > 0) | F.col("headed") | (F.size("found") == 1) | (F.length(x) >= least_intro)))
    row = lambda seq, kind, x: F.struct(seq.cast("int").alias("seq"), F.lit(kind).alias("chunk_type"), x.alias("text"))
    none = F.array().cast("array<struct<seq:int,chunk_type:string,text:string>>")
    parts = F.concat(F.array(row(F.lit(0), "parent", F.col("content"))), F.coalesce(F.transform(kept, lambda x, i: row(i + 1, "child", x)), none))
    return found.select(*columns, F.inline(parts))


def sections(docs: DataFrame, least_intro: int = 60) -> DataFrame:
    """doc_id, seq, chunk_type, text: the whole text as the parent (seq 0) and a child for each second-level heading.

    Text before the first heading is a child if it has at least ``least_intro`` characters; without any heading the
    whole text is the only child. Deeper headings stay inside. A document is cut where it lies; nothing is shuffled.
    """
    return _parts(docs, "doc_id", least_intro=least_intro)


def bounded(text: Column, most: int = 1800) -> Column:
    """array<struct<char_start, text>> of pieces of at most ``most`` characters, cut in one pass; an empty text is one empty piece."""
    piece = lambda start, x: F.struct(start.cast("int").alias("char_start"), x.alias("text"))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)), lambda x, i: piece(i * most, x))
    return F.when(F.length(text) > 0, found).otherwise(F.array(piece(F.lit(0), text)))


def generation_chunks(docs: DataFrame, source: str, revision: Column, most: int = 1800) -> DataFrame:
    """Chunks of a generation: chunk_id, seq, char_start, chunk_type, text and the metadata that reads filter by.

    docs: doc_id, path, content, meta (map). A parent keeps its whole text; children longer than ``most`` are cut, so that an
    embedding service cuts none. Ids hold the source's hash, the document and its revision, children their start too, so two
    generations never share an id unless their texts are the same. Every chunk carries doc_id, source_id, revision and hash.
    A document without an id has chunks without one.
    """
    doc_hash = F.sha2(F.concat(F.to_json("meta"), F.lit("\n"), "content"), 256)
    keyed = docs.select("doc_id", "path", "meta", "content", revision.alias("revision"), doc_hash.alias("doc_hash"))
    parts = _parts(keyed, "doc_id", "path", "meta", "revision", "doc_hash")
    pieces = F.when(F.col("chunk_type") == "child", bounded(F.col("text"), most)).otherwise(F.array(F.struct(F.lit(0).alias("char_start"), F.col("text").alias("text"))))
    cut = parts.select("doc_id", "path", "meta", "revision", "doc_hash", "seq", "chunk_type", F.inline(pieces))
    own = F.concat(F.substring(F.sha2(F.lit(source).cast("binary"), 256), 1, 12), F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"), "revision", F.lit("#"), F.col("seq").cast("string"))
    chunk_id = F.when(F.col("chunk_type") == "parent", own).otherwise(F.concat(own, F.lit(":"), F.col("char_start").cast("string")))
    injected = F.map_from_arrays(F.array(*map(F.lit, ("doc_id", "source_id", "doc_revision", "doc_hash", "source_url"))), F.array(F.col("doc_id").cast("string"), F.lit(source), "revision", "doc_hash", "path"))
    # what is injected wins over a document's own metadata of that name
    metadata = F.map_from_entries(F.concat(F.filter(F.map_entries("meta"), lambda e: ~F.map_contains_key(injected, e["key"])), F.map_entries(injected)))
    return cut.select(chunk_id.alias("chunk_id"), "doc_id", "seq", "char_start", "chunk_type", "text", metadata.alias("metadata"))


def image_references(docs: DataFrame) -> DataFrame:
    """doc_id, nth, target of relative images; absolute, external, anchor and data targets are passed over."""
    found = F.regexp_extract_all("content", F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    return docs.select("doc_id", F.posexplode(found).alias("nth", "target")).where(~F.col("target").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|/|#|//)") & ~F.col("target").contains(".."))
