"""Decisions of a dialogue turn: intent after its overrides, solutions, reasons and questions, search texts, model addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import is_greeting
from tidewater.operators import decisions as D

_REQUESTS = ("troubleshoot", "consult", "other")


def intents(turns: DataFrame, words: DataFrame, allowed: list[str], greetings: tuple[str, ...] = D.GREETINGS) -> DataFrame:
    """id, intent, request, scenarios, correction of turns (id, text, label, request, prior).

    An earlier intent that names a scenario is kept, with its request. Else the label holds if it is allowed, a keyword
    corrects a label 'other', and a request 'other' only stays for a mere greeting. ``scenarios`` are the several
    problems of a first turn. Null labels count as 'other', null requests as 'troubleshoot', a null text as empty.
    """
    said = turns.withColumn("text", F.coalesce("text", F.lit("")))
    fixed = D.spelled_intent(said, words).select("id", F.col("scenario").alias("near"), F.col("matched"))
    several = D.several_problems(said, words).select("id", F.col("scenarios").alias("many"))
    label = F.when(F.col("label").isin(*allowed), F.col("label")).otherwise("other")
    request = F.when(F.col("request").isin(*_REQUESTS), F.col("request")).otherwise("troubleshoot")
    kept = F.coalesce(F.col("prior") != "other", F.lit(False)) & (F.coalesce("prior", F.lit("")) != "")
    corrected = (label == "other") & F.col("near").isNotNull()
    asked = F.when(corrected & (request == "other"), "troubleshoot").otherwise(request)
    narrowed = F.when((asked == "other") & ~is_greeting(F.lower("text"), greetings), "consult").otherwise(asked)
    return said.join(fixed, "id", "left").join(several, "id", "left").select(
        "id", F.when(kept, F.col("prior")).when(corrected, F.col("near")).otherwise(label).alias("intent"),
        F.when(kept, F.coalesce("request", F.lit("troubleshoot"))).otherwise(narrowed).alias("request"),
        F.when(~kept, F.col("many")).alias("scenarios"), F.when(~kept & corrected, F.col("matched")).alias("correction"),
    )


def after_check(missing: Column) -> Column:
    """ask while a required field is missing, else verify."""
    return F.when(F.size(missing) > 0, "ask").otherwise("verify")


def after_risk(level: Column) -> Column:
    return F.when(F.coalesce(level == "auto", F.lit(False)), "execute").otherwise("handoff")


def after_execution(status: Column) -> Column:
    """Only a stated success ends well; a result without status goes to a person."""
    return F.when(F.coalesce(status == "ok", F.lit(False)), "success").otherwise("handoff")


def rule_query(scenario: Column, code: Column, expired: Column) -> Column:
    """Search text of a case that no rule solves. The words are fixed values."""
    state = F.when(scenario == "vpn", F.when(expired, "证书过期").otherwise("证书正常"))
    return F.concat_ws(" ", scenario, F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("Error "), code)), state)


def with_screenshot(text: Column, summary: Column, code: Column, keys: Column) -> Column:
    """A question with what its screenshot says; empty parts are left out. The labels are fixed values."""
    part = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    return F.concat_ws(" ", text, part("截图转译：", summary), part("错误码：", code), part("关键文字：", F.array_join(keys, " ")))


def solutions(cases: DataFrame, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """id, mode, action, risk: the matching rule, else the first hit of a search (id, rank, action, risk), else none.

    A hit without a stated risk counts as high.
    """
    first = hits.groupBy("id").agg(F.min_by(F.struct("action", "risk"), "rank").alias("hit"))
    ruled = F.col("action").isNotNull()
    found = D.solved(cases, rules).join(first, "id", "left")
    return found.select(
        "id", F.when(ruled, "rule").when(F.col("hit").isNotNull(), "search").otherwise("none").alias("mode"),
        F.when(ruled, F.col("action")).when(F.col("hit").isNotNull(), F.coalesce("hit.action", F.lit(""))).alias("action"),
        F.when(ruled, F.col("risk")).when(F.col("hit").isNotNull(), F.coalesce("hit.risk", F.lit("high"))).alias("risk"),
    )


def handoff_reason(error: Column, tool: Column, matched: Column, risk: Column) -> Column:
    """Why a person takes over, the gravest first: a system error, a failed tool, a solution that needs approval, no solution."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("system:"), error)).when(tool == "error", "tool")
        .when(F.coalesce(matched, F.lit(False)), F.concat(F.lit("approval:"), F.coalesce(risk, F.lit("high")))).otherwise("no solution")
    )


def closing(status: Column, certificate: Column) -> Column:
    """Which reply ends a case: only an active scenario has its own."""
    return F.when(F.coalesce(status != "active", F.lit(True)), "unsupported").when(certificate == "error", "error").otherwise("valid")


def questions(missing: Column, templates: dict[str, str]) -> Column:
    """The templates of the missing fields in their order, joined by a semicolon."""
    known = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    return F.array_join(F.transform(missing, lambda f: F.element_at(known, f)), "；")


_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]+)?(#.+)?$"


def endpoint(url: Column, private: bool = False) -> tuple[Column, Column]:
    """(address, refusal) of a model's base URL: without closing slashes, or null and why not.

    Only https to a public host passes unless ``private``. Addresses of reserved IPv4 ranges, and IPv6 addresses outside
    2000::/3, are private; a name counts as public. A null URL is malformed.
    """
    x = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(x, _AUTHORITY, i)
    scheme, netloc = F.lower(part(1)), part(2)
    host = F.lower(F.regexp_extract(netloc, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1))
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("int"))
    a, b, c = (F.get(octets, F.lit(i)) for i in range(3))
    ipv4 = host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    reserved = (
        a.isin(0, 10, 127) | (a >= 240) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    inner = (host == "localhost") | host.endswith(".localhost") | (ipv4 & reserved) | (host.startswith("[") & ~host.rlike(r"^\[[23][0-9a-f]{3}:"))
    refusal = (
        F.when(~scheme.isin("http", "https") | (host == ""), "malformed").when(netloc.contains("@") | (part(4) != "") | (part(5) != ""), "extra parts")
        .when(F.lit(not private) & ((scheme != "https") | inner), "not public")
    )
    return F.when(refusal.isNull(), F.concat(scheme, F.lit("://"), netloc, F.regexp_replace(part(3), "/+$", ""))), refusal
