"""Line dedup by winnowing, in DataFrame operations alone.

A text is a sequence of lines; lines without a word are passed over. A window is a run of ``run`` lines and, where
``words`` is given, also each shorter run of whole lines (single lines included) that holds at least that many words.
Of every window the rightmost least line hash is selected, so any repeated window has a fingerprint in common.
Fingerprints that occur once are dropped; the others are joined to their positions and extended both ways to the windows
that may have selected them, whose content is compared by a 128-bit hash with its first place (in the order of doc_id,
then position). Windows that are not at their first place are repeated; overlapping ones make up the maximal run, and its
lines are deleted. The first place of a line always stays.

Edge cases: a null text has no lines and stays null; texts without a window lose nothing; lines are compared as they
are, case and spaces included; a null doc_id comes before all others, so it is a first place; rows that repeat doc_id and text are one document; other columns stay; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import only, written

RUN = 3
#: Runs of fewer than RUN lines are compared too if they hold so many words (``passages``, the pipeline).
PASSAGE_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]"


def repeated(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, __text_key, places): places of repeated lines among the document's lines with words."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD))
    # without a bound in words no shorter run is a window
    many = F.transform(lines, lambda x: F.least(F.regexp_count(x, F.lit(f"{_WORD}+")), F.lit(words))) if words else F.array().cast("array<int>")
    sizes = range(1, run + 1) if words else (run,)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("__text_key")).where("text is not null").select("doc_id", "__text_key", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), many.alias("m"))
    held = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x)
    hashed = written(hashed.where((F.size("h") >= run) | (held("m") >= words) if words else F.size("h") >= run), "lines")

    def fits(m: Column, start: Column, size: int) -> Column:
        """Whether the lines from start on (from 0) are a window."""
        return F.lit(True) if size == run else held(F.slice(m, start + 1, size)) >= words

    def chosen(size: int) -> Column:
        """Position of the rightmost least hash of each window of this size."""
        least = lambda s: -F.array_min(F.transform(F.sequence(s, s + size - 1), lambda i: F.struct(F.get("h", i).alias("h"), (-i).alias("i"))))["i"]
        starts = F.filter(F.expr(f"sequence(0, size(h) - {size})"), lambda s: fits(F.col("m"), s, size))
        return F.when(F.size("h") >= size, F.transform(starts, least)).otherwise(F.array().cast("array<int>"))

    selected = hashed.withColumn("selected", F.concat(*map(chosen, sizes)))
    prints = selected.select("doc_id", "__text_key", F.explode(F.array_distinct("selected")).alias("at"), "h", "m").select("*", F.get("h", F.col("at")).alias("print"))
    common = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    # extension: the selected line with up to run - 1 lines on either side
    first = F.greatest(F.col("at") - (run - 1), F.lit(0))
    near = lambda c: F.slice(c, first + 1, F.col("at") - first + run)
    around = prints.select("doc_id", "__text_key", "at", "print", near("h").alias("around"), near("m").alias("m"))
    places = around.join(common, "print", "left_semi")

    def windows_of(size: int) -> Column:
        """The windows of this size that hold the selected line: where they start, their size and content."""
        least = F.greatest(F.col("at") - first - (size - 1), F.lit(0))
        most = F.least(F.col("at") - first, F.size("around") - size)
        starts = F.when(most >= least, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda s: fits(F.col("m"), s, size))
        return F.transform(starts, lambda s: F.struct((first + s).alias("start"), F.lit(size).alias("size"), F.slice("around", s + 1, size).alias("w")))

    windows = places.select("doc_id", "__text_key", F.explode(F.concat(*map(windows_of, sizes))).alias("x")).select("doc_id", "__text_key", "x.*")
    windows = windows.select("doc_id", "__text_key", "start", "size", F.xxhash64("w").alias("one"), F.xxhash64(F.reverse("w"), "size").alias("two")).distinct()
    place = F.struct("doc_id", "__text_key", "start")
    origin = windows.groupBy("one", "two").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    late = windows.join(origin, ["one", "two"]).where(place > F.col("origin"))
    return late.groupBy("doc_id", "__text_key").agg(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + size - 1)")))).alias("places"))


COUNTS = ("__lines", "__removed")


def dedup(docs: DataFrame, run: int = RUN, words: int | None = None, counts: tuple[str, str] = COUNTS) -> DataFrame:
    """All documents with the shortened text, and under the names ``counts`` the lines with words before and deleted (columns
    of the table that have these very names give way; ``deduplicated`` takes names that it has not)."""
    with only(docs.sparkSession, "repeated") as keep:
        found = keep(repeated(docs, run, words))
    found = found.select(F.col("doc_id").alias("id"), F.col("__text_key").alias("text_key"), "places")
    # the table's own columns go by number meanwhile, so that none of their names clashes
    docs = docs.drop(*counts)
    numbers = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    own = docs.toDF(*numbers.values())
    doc_id, text = own[numbers["doc_id"]], own[numbers["text"]]
    # never broadcast, so that a small input costs what a share of a large one does
    joined = own.join(found.hint("merge"), doc_id.eqNullSafe(found["id"]) & (F.xxhash64(text) == found["text_key"]), "left")
    joined = joined.withColumn("lines", F.split(text, "\n", -1))
    joined = joined.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_WORD), i).otherwise(-1)), lambda i: i >= 0))
    joined = joined.withColumn("gone", F.transform("places", lambda p: F.get("worded", p)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    short = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    short = F.when(F.col("places").isNotNull(), short).otherwise(text)
    return joined.select(
        *((short if x == "text" else F.col(c)).alias(x) for x, c in numbers.items()),
        F.coalesce(F.size("worded"), F.lit(0)).cast("long").alias(counts[0]), F.greatest(F.size("gone"), F.lit(0)).cast("long").alias(counts[1]),
    )


def passages(docs: DataFrame, counts: tuple[str, str] = COUNTS) -> DataFrame:
    """``dedup`` of runs of RUN lines and of all shorter runs of PASSAGE_WORDS words."""
    return dedup(docs, RUN, PASSAGE_WORDS, counts)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with texts shortened by ``passages``; those that lost all their lines with words go."""
    free = "_" * max(map(len, docs.columns))
    lines, removed = (f"{free}{x}" for x in COUNTS)
    found = passages(docs, (lines, removed)).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines))).drop(lines, removed)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


#: The result of ``dedup`` in DuckDB, for run = 3: windows are compared by their whole text.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, k, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS run FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY k)
), r AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS nth FROM w WHERE run IS NOT NULL
), gone AS (
  SELECT DISTINCT r.doc_id, r.k + j.j AS k FROM r, (SELECT unnest([0, 1, 2]) AS j) j WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AS worded, g.k IS NOT NULL AS cut
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.k = g.k
), s AS (
  SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
