"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(x: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(x, SPACES, "")


def tokens(x: Column) -> Column:
    """Runs of letters and digits, case kept; runs of Han characters become overlapping bigrams."""
    words = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    runs = F.regexp_extract_all(x, F.lit(r"\p{IsHan}+"), F.lit(0))
    bigrams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.when(x.rlike(r"\p{IsHan}"), F.concat(words, bigrams)).otherwise(words)


def error_codes(x: Column) -> Column:
    """Numbers of three or four digits that stand alone."""
    return F.regexp_extract_all(x, F.lit(r"\b(\d{3,4})\b"), F.lit(1))


def enhanced_query(x: Column) -> Column:
    """The question with its error codes appended once more."""
    codes = error_codes(x)
    return F.when(F.size(codes) > 0, F.concat(x, F.lit(" "), F.array_join(codes, " "))).otherwise(x)


def embedding_input(x: Column, longest: int = 1800) -> Column:
    """Without control characters (line breaks too), cut to what an embedding service takes."""
    return F.substring(F.regexp_replace(x, r"[\x00-\x1f\x7f]", ""), 1, longest)


def date_int(x: Column) -> Column:
    """YYYY-MM-DD... as the int YYYYMMDD, null if that can't be read."""
    return F.replace(F.substring(x, 1, 10), F.lit("-"), F.lit("")).try_cast("int")


def is_greeting(x: Column, words: tuple[str, ...]) -> Column:
    """Nothing but greeting words and punctuation. The words go out one after another."""
    rest = x
    for w in words:
        rest = F.replace(rest, F.lit(w), F.lit(""))
    return F.length(F.regexp_replace(rest, r"[^\p{L}\p{N}_]", "")) == 0


def near_keyword(message: Column, keyword: Column) -> Column:
    """What of a message meets a keyword: the keyword itself, else the first Latin word one edit away from it, else null."""
    word, text = F.lower(keyword), F.lower(message)
    typed = F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.levenshtein(t, word, 1) >= 0)
    fuzzy = word.rlike(r"^\p{ASCII}*$") & word.rlike(r"\p{Alpha}")
    return F.when(F.contains(text, word), word).when(fuzzy, F.get(typed, F.lit(0)))


def is_read_only_request(x: Column) -> Column:
    """The user only asks, or forbids an action. The pattern is a fixed value."""
    return x.rlike(
        r"(?:只(?:想|是|要)?(?:咨询|询问|了解|知道|查询)|仅(?:咨询|询问|了解|查询)|只读)"
        r"|(?:不要|不用|无需|不需要|先别|暂不|禁止|请勿|别)\s*(?:自动\s*)?(?:续期|续签|执行|操作|处理)"
    )


def is_reopen_request(x: Column) -> Column:
    """The answer did not help; the phrases are fixed values."""
    start = stripped(x)
    return start.startswith("未解决") | start.startswith("没有解决") | start.startswith("还没好") | start.startswith("没解决")


def sentences(x: Column) -> Column:
    """Sentences with a citation that follows the full stop put back to its sentence, blank ones left out."""
    parts = F.split(x, r"[。！？；!?;\n]|\.(?=\s|$)", -1)
    lead = r"^\s*(?:\[证据[1-9][0-9]*\]\s*)+"
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        joins = (F.size(acc) > 0) & F.get(acc, F.size(acc) - 1).rlike(r"\S") & part.rlike(lead)
        moved = F.concat(F.get(acc, F.size(acc) - 1), F.regexp_extract(part, lead, 0))
        kept = F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(moved))).otherwise(acc)
        return F.concat(kept, F.array(F.when(joins, F.regexp_replace(part, lead, "")).otherwise(part)))

    return F.filter(F.aggregate(parts, empty, step), lambda s: s.rlike(r"\S"))


def citations(x: Column) -> Column:
    """Numbers of well-formed citations."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[证据([1-9][0-9]*)\]"), F.lit(1)))


def evidence_text(x: Column, longest: int = 800) -> Column:
    """Numbered evidence of an array of texts, a blank line between."""
    return F.array_join(F.transform(x, lambda t, i: F.concat(F.lit("[证据"), i + 1, F.lit("] "), F.substring(t, 1, longest))), "\n\n")


def term_coverage(answer: Column, terms: Column) -> Column:
    """Share of an array of terms that the answer contains, spaces aside; null without terms."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return F.size(F.filter(terms, lambda t: F.contains(bare(answer), bare(t)))) / F.nullif(F.size(terms), F.lit(0))


def duration(ms: Column) -> Column:
    """A duration for people: '<1 ms', 'n ms' or 'n.n s'."""
    return F.when(ms.isNull(), None).when(ms < 1, "<1 ms").when(ms < 1000, F.format_string("%d ms", F.round(ms).cast("long"))).otherwise(F.format_string("%.1f s", ms / 1000))


def first_json(x: Column) -> Column:
    """The first brace-delimited text of a noisy answer, null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def grounded(query: Column, evidence: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Some word of at least two characters, no stop word, that the evidence contains."""
    return F.exists(tokens(query), lambda t: (F.length(t) >= 2) & ~t.isin(*stop_words or ("",)) & F.contains(evidence, t))


def safe_path(x: Column) -> Column:
    """A relative path without parent steps or control characters."""
    return (F.length(x).between(1, 4096)) & ~x.startswith("/") & ~x.rlike(r"[\x00-\x1f\x7f\\]") & ~x.rlike(r"(?:^|/)\.\.(?:/|$)")


def first_hop(forwarded: Column) -> Column:
    """The first address of an X-Forwarded-For value."""
    return F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
