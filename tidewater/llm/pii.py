"""Personal data by weak supervision, in DataFrame operations alone.

Base spans (email, ip, card, phone) come from fixed patterns with checks. Candidates of further kinds come from wider
patterns and gazetteers: secrets (values given to credentials' names, key-like words), names (forms of address or given
names with a surname), street addresses, dates that may be of birth, national ids and local phone numbers. Regex,
gazetteer and context labelers vote on each (for, against or nothing). Spark counts the vote patterns of all documents
(at most 3**6 for a kind), expectation-maximisation on those counts estimates each labeler's reliabilities for a kind,
and the patterns' posteriors train the kind's naive Bayes span classifier on bounded features, again by Spark counts. A
candidate that a labeler backs, that the classifier takes and that no base span or earlier kind overlaps becomes a span.

Positions are code points: the texts between the matches of a pattern (its split) and the matches give the offsets.

Edge cases: a null text is empty and has no spans; without any candidate nothing is added; repeated doc_ids are judged
row by row; an empty table gives an empty result; other columns are ignored; a text with very many matches costs about
as much for each as one with few.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import written

#: The base patterns, with possessive repeats where giving back could never help.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Base kinds, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "name", "address", "birth", "id", "tel")
BASE = 4
#: Gazetteers: names of what people keep to themselves, forms of address, given names, kinds of street.
NAMES = "token|key|apikey|api_key|secret|password|passwd|pwd|auth|bearer|credential|credentials|ssn|iban|passport|account|login|pin"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme"
GIVEN = (
    "Anna|Anne|Carlos|Carmen|Charlotte|Daniel|David|Elena|Elizabeth|Emma|Franz|Hans|Hélène|James|Jean|John|José|Juan|Julia|Karl|Laura|Lucía|"
    "Maria|María|Marie|Mary|Michael|Miguel|Pablo|Paul|Peter|Pierre|Robert|Sarah|Sophie|Susan|Thomas|William"
)
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court"
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
CREDENTIALS = r"(?i:password|passwd|pwd|secret|token|api_key|apikey|pin|login)[\"']?[\x20]?[:=][\x20]?[\"']?"
_CREDENTIALS_START = "PpSsTtAaLl"
#: Where each further kind may be: a word of key characters with a digit or the value that is given to a credential's name, ...
_GIVEN = "{GIVEN}"  # where the patterns take the given names
CANDIDATES = {
    "secret": rf"(?=[{_CREDENTIALS_START}])(?<![A-Za-z])(?:{CREDENTIALS})[^\x00-\x20\"',;:=]{{4,}}+|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{{12,}}+",
    "name": rf"(?=[A-Z])(?<![\p{{L}}])(?:(?:{TITLES})\.?[\x20](?:{_CAP}[\x20-])?{_CAP}|(?:{_GIVEN})[\x20](?:[A-Z]\.[\x20])?{_CAP})(?![\p{{L}}])",
    "address": rf"(?=[A-Z0-9])(?<![\p{{L}}0-9])(?:[0-9]{{1,5}}[\x20](?:{_CAP}[\x20]){{1,3}}(?:{STREETS})|{_CAP}(?:straße|strasse|weg|gasse|platz)[\x20][0-9]{{1,4}}|(?:Calle|Avenida|Rue|Avenue|Place)[\x20](?:(?:de|del|la|des|du)[\x20])*{_CAP},?[\x20][0-9]{{1,4}})(?![\p{{L}}0-9])",
    "birth": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+)(-])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20/-])[0-9]{3,4}[\x20-][0-9]{3,5}(?![0-9-])",
}
#: A cheaper test that keeps the pattern off most texts.
_MAY = {
    "secret": r"[0-9]|[:=]", "name": rf"(?=[A-Z])(?:{TITLES}|{_GIVEN})[\x20.]", "address": r"[A-Z][\p{L}]+,?[\x20][0-9]|[0-9][\x20][A-Z]",
    "birth": r"[0-9][./-][0-9]{1,2}[./-][0-9]", "id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "tel": r"[0-9)][\x20/-]?[0-9]{3,4}[\x20-][0-9]{3}",
}
#: Words before a candidate that speak for its kind.
_BEFORE = {
    "secret": rf"(?i)(?:^|[^a-z0-9])(?:{NAMES})[\x20\"':=]*$", "name": r"(?i)(?:name|signed|dear|by|from|contact|regards)[\x20:,]*$",
    "address": r"(?i)(?:address|lives|at|located|street|anschrift|dirección|adresse|to)[\x20:,]*$",
    "birth": r"(?i)(?:born|birth|dob|birthday|geboren|geb\.|nacid[oa]|née?)[\x20:,]*(?:on|am|el|le)?[\x20]?$",
    "id": r"(?i)(?:ssn|social|social[\x20]security|security[\x20](?:number|no\.?|id)|national[\x20]id|personal[\x20]id|my[\x20]id)[\x20:#]*(?:is[\x20])?$", "tel": r"(?i)(?:tel|telefon|phone|call|mobile|cell|fax|teléfono|téléphone|at)[\x20.:]*$",
}
_SHAPE = {
    "secret": r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$",
    "name": rf"^(?:{TITLES})\b|^(?:{_GIVEN})[\x20]", "address": rf"(?:{STREETS}|straße|strasse|gasse)\b", "birth": r"(?:19[0-9]{2}|200[0-9])",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "tel": r"^(?=(?:\D*[0-9]){9,12}\D*$)[(0]",
}
_HARMLESS = {
    "secret": r"^(?:[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}.*|[A-Za-z]+[-_/=+]*[0-9]{1,4}|[0-9_+/=-]+|.*[A-Za-z]{2,}[/_-][A-Za-z]{2,}.*)$",
    "name": rf"(?:{STREETS})$", "address": r"^[0-9]{4}[\x20]", "birth": r"20[2-9][0-9]", "id": r"^(?:[0-9])\1", "tel": r"^[0-9]{4}-[0-9]{4}-",
}
#: Words before a candidate that speak against any kind, and against one.
_AGAINST = r"(?i)(?:version|page|isbn|license|chapter|copyright|section)[\x20]*$"
_AGAINST_KIND = {
    "id": r"(?i)(?:part|item|order|model|serial|invoice|article|catalogue|catalog|sku|ref|lot|case|ticket)(?:[\x20](?:no\.?|nr\.?|number|id))?[\x20:#.]*$",
    "tel": r"(?i)(?:ratio|score|range|lines?|rows?|pages?|order|part|item|model|serial|invoice|ref|lot)(?:[\x20](?:no\.?|nr\.?|number|of))?[\x20:#.]*$",
    "name": r"(?i)(?:street|avenue|the|hotel|university|museum|airport|bridge|hurricane)[\x20]$",
}
#: Votes of the labelers, in order: shape, mixture, gazetteer, assignment, harmless forms, plain words.
LABELERS = 6
_ROUNDS = 60
MOST_NAMES = 10_000
#: What labelers are believed to be before any vote is counted, as that many candidates of either class would show it.
PRIOR_ROWS = 300


_SPAN = "struct<start:int,end:int,value:string,before:string>"
_CONTEXT = 24  # characters before a match that are kept
_RUN = 256


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the pattern's matches, in code points, with the _CONTEXT characters before.

    Offsets are running sums of the lengths of matches and of the texts between. They are gathered in runs of _RUN, as
    an array is copied when something is appended: so many matches in a text cost about as much each as few.
    """
    value, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # one more than there are matches: the text after the last one
    pairs = F.zip_with(value, gap, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    start = lambda out: F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(out).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        before = F.right(F.concat(acc["tail"], F.right(x["gap"], F.lit(_CONTEXT))), F.lit(_CONTEXT))
        found = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))
        tail = F.right(F.concat(before, x["value"]), F.lit(_CONTEXT))
        return F.struct(end.alias("at"), tail.alias("tail"), F.array_append(acc["out"], found).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("out")), step)
        return F.struct(inner["at"].alias("at"), inner["tail"].alias("tail"), F.array_append(acc["out"], inner["out"]).alias("out"))

    def gathered(p: Column) -> Column:
        matches = F.slice(p, F.lit(1), F.size(p) - 1)
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _RUN).cast("int")), lambda i: F.slice(matches, i * _RUN + 1, F.lit(_RUN)))
        return F.aggregate(runs, start(f"array<array<{_SPAN}>>"), run, lambda acc: F.flatten(acc["out"]))

    # the one-element array binds the pairs, so that the pattern is matched once
    return F.element_at(F.transform(F.array(pairs), gathered), 1)


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind. A cheap test keeps the pattern off most texts."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    octet = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    email = _where(text.contains("@"), places(text, EMAIL))
    ip = F.filter(
        _where(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), places(text, IP)),
        lambda x: F.forall(F.split(x["value"], r"\."), lambda p: (F.length(octet(p)) < 3) | ((F.length(octet(p)) == 3) & (octet(p) <= "255"))),
    )
    card = F.filter(
        _where(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), places(text, CARD)),
        lambda x: F.length(digits(x)).between(14, 19) & _luhn(digits(x)),
    )
    phone = F.filter(_where(text.contains("+"), places(text, PHONE)), lambda x: F.length(digits(x)).between(10, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def gazetteer(names) -> str:
    """Alternation of given names, from a bounded table's rows or a list; GIVEN is the default of all functions here."""
    found = sorted({n.strip() for n in names if n and n.strip()})
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return "|".join(re.escape(n).replace("\\ ", "[\\x20]") for n in found) or "(?!)"


def _with(pattern: str, given: str) -> str:
    return pattern.replace(_GIVEN, given)


def candidates(text: Column, given: str = GIVEN) -> Column:
    """array<struct<rank, start, end, value, before>> of all further kinds' candidates."""

    def as_kind(rank: int):
        def of(x: Column) -> Column:
            # a credential's name goes to the context
            value = F.regexp_replace(x["value"], f"^{CREDENTIALS}", "") if rank == BASE else x["value"]
            start = x["end"] - F.length(value)
            name = F.substring(x["value"], F.lit(1), start - x["start"])
            before = F.right(F.concat(x["before"], name), F.lit(_CONTEXT)) if rank == BASE else x["before"]
            return F.struct(F.lit(rank).alias("rank"), start.alias("start"), x["end"].alias("end"), value.alias("value"), before.alias("before"))

        return of

    return F.concat(*(F.transform(_where(text.rlike(_with(_MAY[k], given)), places(text, _with(CANDIDATES[k], given))), as_kind(KINDS.index(k))) for k in KINDS[BASE:]))


def _by_kind(rank: Column, of) -> Column:
    """of(kind) for the candidate's kind."""
    found = F.lit(None)
    for i, kind in enumerate(KINDS[BASE:], BASE):
        found = F.when(rank == i, of(kind)).otherwise(found)
    return found


def votes(rank: Column, value: Column, before: Column, given: str = GIVEN) -> list[Column]:
    """1, -1 or 0 of each labeler."""
    kinds = value.rlike("[0-9]").cast("int") + value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int")
    variety = F.size(F.array_distinct(F.split(value, "")))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    secret = rank == BASE
    return [
        vote(_by_kind(rank, lambda k: value.rlike(_with(_SHAPE[k], given))), secret & (F.length(value) < 14)),
        vote(secret & (F.length(value) >= 16) & (kinds >= 2) & (variety >= 9), F.when(secret, (kinds < 2) | (variety < 6)).otherwise(variety < 4)),
        vote(_by_kind(rank, lambda k: before.rlike(_BEFORE[k])), F.lit(False)),
        vote(before.rlike(r"[\p{L}0-9_][\x20]?[:=][\x20]?[\"']?$"), before.rlike(r"[A-Za-z/][.,/]$") & secret),
        vote(F.lit(False), _by_kind(rank, lambda k: value.rlike(_HARMLESS[k])) | before.rlike(_AGAINST) | F.coalesce(_by_kind(rank, lambda k: before.rlike(_AGAINST_KIND.get(k, "(?!)"))), F.lit(False))),
        vote(secret & value.rlike("[0-9].*[A-Za-z].*[0-9].*[A-Za-z]"), secret & value.rlike("^[a-zA-Z]+[0-9]{1,2}$|^[0-9]{1,2}[a-zA-Z]+$")),
    ]


def estimate(counts: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], list[list[list[float]]]]:
    """Expectation-maximisation on vote patterns: posterior of each, and per labeler P(yes, none, no | class).

    It is anchored, so that few or one-sided patterns cannot turn the classes round: what labelers are believed to be counts
    like PRIOR_ROWS candidates of either class, and a labeler whose yes comes to speak against the class, or whose no comes
    to speak for it, says nothing.
    """
    index = {1: 0, 0: 1, -1: 2}
    # votes are right more often than not
    believed = [[0.45, 0.4, 0.15], [0.15, 0.4, 0.45]]
    chance = [[list(row) for row in believed] for _ in range(LABELERS)]
    prior = 0.3
    posterior: dict[tuple[int, ...], float] = {}
    total = sum(counts.values())
    for _ in range(_ROUNDS):
        for pattern in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][0][index[v]] / chance[k][1][index[v]]) for k, v in enumerate(pattern))
            posterior[pattern] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        yes = sum(counts[p] * posterior[p] for p in counts)
        # never so low that one labeler's yes is nothing among many candidates that none speaks of
        prior = min(0.95, max(0.3, (yes + 0.3 * PRIOR_ROWS) / (total + PRIOR_ROWS)))
        for k in range(LABELERS):
            seen = [[PRIOR_ROWS * x for x in row] for row in believed]
            for pattern, n in counts.items():
                seen[0][index[pattern[k]]] += n * posterior[pattern]
                seen[1][index[pattern[k]]] += n * (1 - posterior[pattern])
            rows = [[x / sum(row) for x in row] for row in seen]
            if rows[0][0] < rows[1][0] or rows[0][2] > rows[1][2]:
                rows = [[(a + b) / 2 for a, b in zip(*rows, strict=True)]] * 2
            chance[k] = rows
    return posterior, chance


def features(rank: Column, value: Column, before: Column, given: str = GIVEN) -> Column:
    """Names of a candidate's features, its kind first; at most a few hundred for a kind."""
    word = F.regexp_extract(F.lower(before), r"([a-z_]+)[^a-z_]*$", 1)
    letters = F.concat(*(F.when(value.rlike(x), F.lit(y)).otherwise(F.lit("-")) for x, y in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[g-zG-Z]", "z"), ("[_+/=-]", "_"))))
    parts = (
        ("word", F.pmod(F.crc32(word.cast("binary")), F.lit(128))), ("letters", letters), ("length", F.least(F.length(value) / 4, F.lit(16)).cast("int")),
        ("digits", (10 * F.length(F.regexp_replace(value, "[^0-9]", "")) / F.length(value)).cast("int")),
        ("mark", F.regexp_extract(before, r"([^A-Za-z0-9])$", 1).isin('"', "'", ":", "=", "(", "[")), ("shape", _by_kind(rank, lambda k: value.rlike(_with(_SHAPE[k], given)))),
        ("context", _by_kind(rank, lambda k: before.rlike(_BEFORE[k]))), ("against", _by_kind(rank, lambda k: before.rlike(_AGAINST_KIND.get(k, "(?!)")))),
    )
    return F.array(*(F.concat_ws(":", rank, F.lit(name), of.cast("string")) for name, of in parts))


def _table(pairs: dict[str, float]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k in pairs)), F.array(*(F.lit(float(v)) for v in pairs.values()))) if pairs else F.expr("map('', 0D)")


def train(found: DataFrame, given: str = GIVEN) -> dict[str, float]:
    """Log-odds of each feature, and of each kind's prior (``rank:prior``), from all candidates (rank, value, before).

    Labelers' reliabilities and the classifier are a kind's own.
    """
    each = [F.col(x) for x in ("rank", "value", "before")]
    voted = found.select("rank", F.concat_ws(",", *votes(*each, given)).alias("pattern"), features(*each, given).alias("features"))
    counts: dict[int, dict[tuple[int, ...], int]] = {}
    for r in voted.groupBy("rank", "pattern").agg(F.count("*").alias("n")).collect():  # at most 3**LABELERS rows for a kind
        counts.setdefault(r["rank"], {})[tuple(map(int, r["pattern"].split(",")))] = r["n"]
    if not counts:
        return {}
    posterior = {rank: estimate(of)[0] for rank, of in counts.items()}
    known = _table({f"{rank}:{','.join(map(str, k))}": v for rank, of in posterior.items() for k, v in of.items()})
    p = F.element_at(known, F.concat_ws(":", "rank", "pattern"))
    rows = voted.select("rank", p.alias("p"), F.explode("features").alias("feature")).groupBy("rank", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    odds: dict[str, float] = {}
    size: dict[str, int] = {}
    for r in rows:
        group = r["feature"].rsplit(":", 1)[0]
        size[group] = size.get(group, 0) + 1
    total = {rank: [sum(counts[rank][k] * (v if of else 1 - v) for k, v in posterior[rank].items()) for of in (True, False)] for rank in counts}
    for r in rows:
        g, (yes, no) = size[r["feature"].rsplit(":", 1)[0]], total[r["rank"]]
        odds[r["feature"]] = math.log((r["yes"] + 0.5) / (yes + 0.5 * g)) - math.log((r["no"] + 0.5) / (no + 0.5 * g))
    return odds | {f"{rank}:prior": math.log((yes + 0.5) / (no + 0.5)) for rank, (yes, no) in total.items()}


def _as_span(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x["end"].alias("end"))


def find(docs: DataFrame, given: str = GIVEN) -> DataFrame:
    """doc_id and spans: array<struct<start, rank, kind, end>> in order, the base kinds' ranks being 0 to 3. ``given``: see ``gazetteer``."""
    text = F.coalesce("text", F.lit(""))
    spans = base_spans(F.col("text"))
    base = F.concat(*(F.transform(spans[k], _as_span(i)) for i, k in enumerate(KINDS[:BASE])))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", F.array_sort(base).alias("base"), candidates(F.col("text"), given).alias("candidates"))
    found = written(found, "pii")
    table = _table(train(found.select(F.explode("candidates").alias("c")).select("c.rank", "c.value", "c.before"), given))
    odds = lambda x: F.coalesce(F.try_element_at(table, x), F.lit(0.0))
    each = lambda c: (c["rank"], c["value"], c["before"], given)
    score = lambda c: F.aggregate(features(*each(c)), odds(F.concat_ws(":", c["rank"], F.lit("prior"))), lambda a, f: a + odds(f))
    # no labeler's word, no span; and none against the word of what is harmless
    backed = lambda c: (F.greatest(*votes(*each(c))) > 0) & (votes(*each(c))[4] >= 0)
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    taken = F.filter("candidates", lambda c: backed(c) & (score(c) > 0) & ~F.exists("base", lambda b: meets(b, c)))
    found = found.select("doc_id", "base", taken.alias("taken"))
    alone = F.filter("taken", lambda c: ~F.exists("taken", lambda d: (d["rank"] < c["rank"]) & meets(c, d)))
    added = F.transform(alone, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), F.element_at(F.array(*map(F.lit, KINDS)), c["rank"] + 1).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
