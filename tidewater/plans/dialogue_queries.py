"""Registered queries of dialogue decisions, answer scores and sync reports, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import decisions as D
from tidewater.operators import dialogue as T
from tidewater.operators import evaluation as E
from tidewater.operators import metrics as M
from tidewater.plans import adapt as A

Q, SQL = {}, {}


def query(sql: str):
    def register(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _of(n: Column, *values: str | None) -> Column:
    """The value at n modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


_WORDS = [("vpn", 0, "tunnel"), ("vpn", 1, "dialup"), ("email", 2, "mailbox"), ("password", 3, "passphrase")]
_TEXTS = ("hello hey", "my tunnel is down", "the tunnle is down", "tunnel and mailbox fail", "good weather today", "a mailbox for my passphrase")
_LABELS, _REQUESTED, _PRIOR = ("vpn", "other", "printer", None, "other"), ("other", "troubleshoot", "consult", "shout", None), (None, "other", "email", "")
_literal = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"""WITH k(scenario, nth, keyword) AS (VALUES {', '.join(f"('{a}', {b}, '{c}')" for a, b, c in _WORDS)}),
t AS (SELECT conv_id * 100 + turn AS id, {_literal(_TEXTS)}[(conv_id + turn) % 6 + 1] AS text, {_literal(_LABELS)}[conv_id % 5 + 1] AS label, {_literal(_REQUESTED)}[(conv_id // 5 + turn) % 5 + 1] AS request, {_literal(_PRIOR)}[(conv_id // 7) % 4 + 1] AS prior FROM conversations),
h AS (SELECT t.id, scenario, nth, keyword, CASE WHEN contains(text, keyword) THEN keyword ELSE list_filter(string_split(text, ' '), lambda x: levenshtein(x, keyword) <= 1)[1] END AS hit, contains(text, keyword) AS whole FROM t, k),
n AS (SELECT id, min(scenario) AS near, arg_min(CASE WHEN keyword = hit THEN keyword ELSE keyword || '≈' || hit END, nth) AS matched FROM h WHERE hit IS NOT NULL GROUP BY id HAVING count(DISTINCT scenario) = 1),
m AS (SELECT id, string_agg(DISTINCT scenario, ',' ORDER BY scenario) AS many FROM h WHERE whole GROUP BY id HAVING count(DISTINCT scenario) >= 2),
x AS (SELECT t.*, near, matched, many, coalesce(prior NOT IN ('', 'other'), false) AS kept, CASE WHEN label = 'vpn' THEN 'vpn' ELSE 'other' END AS l, CASE WHEN t.request IN ('other', 'consult') THEN t.request ELSE 'troubleshoot' END AS r FROM t LEFT JOIN n USING (id) LEFT JOIN m USING (id)),
y AS (SELECT *, l = 'other' AND near IS NOT NULL AS corrected FROM x)
SELECT id, CASE WHEN kept THEN prior WHEN corrected THEN near ELSE l END AS intent, CASE WHEN kept THEN coalesce(request, 'troubleshoot') WHEN r <> 'other' THEN r WHEN corrected THEN 'troubleshoot' WHEN text = 'hello hey' THEN 'other' ELSE 'consult' END AS request,
CASE WHEN NOT kept THEN many END AS scenarios, CASE WHEN NOT kept AND corrected THEN matched END AS correction FROM y""")
def intent_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with planted texts, labels and requests, right, unknown and null ones."""
    c, t = F.col("conv_id"), F.col("turn")
    turns = A.table(spark, sf_dir, "conversations").select(
        (c * 100 + t).alias("id"), _of(c + t, *_TEXTS).alias("text"), _of(c, *_LABELS).alias("label"),
        _of(F.expr("conv_id div 5") + t, *_REQUESTED).alias("request"), _of(F.expr("conv_id div 7"), *_PRIOR).alias("prior"),
    )
    words = spark.createDataFrame(_WORDS, "scenario string, nth int, keyword string")
    return T.intents(turns, words, ["vpn", "email", "password", "software", "other"])


@query(f"""WITH {A.TRACES} SELECT id, CASE WHEN k % 2 = 0 THEN 'ask' ELSE 'verify' END AS after_check, CASE WHEN k % 5 = 0 THEN 'fail' WHEN k % 3 = 0 THEN 'expired' ELSE 'valid' END AS after_verification,
CASE WHEN k % 4 = 0 THEN 'execute' ELSE 'handoff' END AS after_risk, CASE WHEN k % 3 = 0 THEN 'success' ELSE 'handoff' END AS after_execution FROM traces""")
def graph_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    missing = F.when(k % 2 == 0, F.array(F.lit("device"))).otherwise(F.array().cast("array<string>"))
    return A.traces(spark, sf_dir).select(
        "id", T.after_check(missing).alias("after_check"), D.after_verification(k % 5 == 0, k % 3 == 0).alias("after_verification"),
        T.after_risk(_of(k, "auto", "human", None, "high")).alias("after_risk"), T.after_execution(_of(k, "ok", "error", None)).alias("after_execution"),
    )


@query(f"""WITH {A.TRACES} SELECT id, CASE WHEN k % 3 = 0 THEN CASE k % 2 WHEN 0 THEN 'vpn Error 800 证书过期' ELSE 'vpn Error 800 证书正常' END WHEN k % 3 = 1 THEN 'email Error 800' ELSE 'email' END AS rule_query,
CASE k % 4 WHEN 0 THEN node || ' 截图转译：a dialog 错误码：720 关键文字：retry close' WHEN 1 THEN node || ' 错误码：720' WHEN 2 THEN node ELSE node || ' 截图转译：a dialog' END AS screenshot_query FROM traces""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    keys = F.when(k % 4 == 0, F.array(F.lit("retry"), F.lit("close"))).when(k % 4 == 1, F.array().cast("array<string>"))
    return A.traces(spark, sf_dir).select(
        "id", T.rule_query(_of(k, "vpn", "email", "email"), _of(k, "800", "800", ""), k % 2 == 0).alias("rule_query"),
        T.with_screenshot(F.col("node"), _of(k, "a dialog", None, "", "a dialog"), _of(k, "720", "720", None, ""), keys).alias("screenshot_query"),
    )


@query(f"""WITH {A.TRACES}, c AS (SELECT id, CASE k % 3 WHEN 0 THEN '800' WHEN 1 THEN '720' ELSE '619' END AS code, k % 2 = 0 AS expired, k FROM traces),
rules(code, expired, action, risk) AS (VALUES ('800', true, 'vpn.renew_certificate', 'low'), ('800', false, 'vpn.check_client_config', 'low'), ('720', true, 'vpn.rebuild_connection', 'medium'))
SELECT c.id, CASE WHEN r.action IS NOT NULL THEN 'rule' WHEN k % 4 <> 3 THEN 'search' ELSE 'none' END AS mode, coalesce(r.action, CASE k % 4 WHEN 0 THEN 'open_ticket' WHEN 1 THEN '' WHEN 2 THEN 'restart' END) AS action,
coalesce(r.risk, CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'high' END) AS risk FROM c LEFT JOIN rules r ON r.code = c.code AND r.expired = c.expired""")
def solution_or_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits for most cases; the first by rank counts, with its action or risk left out in some."""
    k = F.col("k")
    traces = A.traces(spark, sf_dir)
    cases = traces.select("id", F.lit("vpn").alias("scenario"), _of(k, "800", "720", "619").alias("error_code"), (k % 2 == 0).alias("cert_expired"))
    some = traces.where("k % 4 <> 3")
    first = some.select("id", F.lit(1).alias("rank"), _of(k, "open_ticket", None, "restart", None).alias("action"), _of(k, "low", None, None, None).alias("risk"))
    return T.solutions(cases, D.rules(spark), first.unionByName(some.select("id", F.lit(2).alias("rank"), F.lit("other").alias("action"), F.lit("low").alias("risk"))))


_ASKED = {"device": "Which device?", "error_code": "Which code?"}


@query(f"""WITH {A.TRACES} SELECT id, CASE WHEN k % 7 = 0 THEN 'system:timeout' WHEN k % 3 = 0 THEN 'tool' WHEN k % 5 = 0 THEN 'approval:' || CASE WHEN k % 2 = 0 THEN 'medium' ELSE 'high' END ELSE 'no solution' END AS reason,
CASE k % 3 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'valid' END ELSE 'unsupported' END AS closing, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Which device?' WHEN 2 THEN 'Which code?' ELSE 'Which device?；Which code?' END AS question FROM traces""")
def reply_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    missing = F.array_compact(F.array(F.when(k % 2 == 1, F.lit("device")), F.when(k % 4 >= 2, F.lit("error_code"))))
    return A.traces(spark, sf_dir).select(
        "id", T.handoff_reason(F.when(k % 7 == 0, "timeout"), F.when(k % 3 == 0, "error").when(k % 3 == 1, "ok"), F.when(k % 2 == 0, k % 5 == 0).otherwise(F.when(k % 5 == 0, True)), F.when(k % 2 == 0, "medium")).alias("reason"),
        T.closing(_of(k, "coming", "active", None), F.when(k % 2 == 0, "error")).alias("closing"), T.questions(missing, _ASKED).alias("question"),
    )


_URLS = {
    " https://api.example.com/v1// ": ("https://api.example.com/v1", None), "HTTPS://API.example.com:8443": ("https://API.example.com:8443", None), "http://api.example.com": (None, "not public"),
    "https://localhost/v1": (None, "not public"), "https://10.2.3.4/v1": (None, "not public"), "https://172.31.0.1": (None, "not public"), "https://172.32.0.1/": ("https://172.32.0.1", None),
    "https://u:p@example.com": (None, "extra parts"), "https://example.com/?q=1": (None, "extra parts"), "ftp://example.com": (None, "malformed"), "api.example.com": (None, "malformed"), "https:///v1": (None, "malformed"),
    "https://[::1]/v1": (None, "not public"), "https://[2606:4700::1]/v1": ("https://[2606:4700::1]/v1", None), "https://x.localhost:1/": (None, "not public"),
}


@query(f"""SELECT page_id, {_literal([a for a, _ in _URLS.values()])}[page_id % {len(_URLS)} + 1] AS address, {_literal([r for _, r in _URLS.values()])}[page_id % {len(_URLS)} + 1] AS refusal,
regexp_extract(url, '^(https?://[^?#]*?)/*(?:[?#].*)?$', 1) AS page_address FROM pages""")
def endpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted addresses of all kinds, and each page's own one without query and fragment, where private hosts may be."""
    pages = A.table(spark, sf_dir, "pages")
    address, refusal = T.endpoint(_of(F.col("page_id"), *_URLS))
    own, _ = T.endpoint(F.regexp_replace("url", r"[?#].*$", ""), private=True)
    return pages.select("page_id", address.alias("address"), refusal.alias("refusal"), F.coalesce(own, F.lit("")).alias("page_address"))


_SAID = (
    "The tunnel needs a renewal [证据1]. Restart it [证据2].", "The tunnel needs a renewal. Restart it [证据2].", "Restart it. [证据2] The tunnel needs a renewal [证据1][证据3].",
    "The tunnel needs a renewal [证据1]. Restart it [证据9].", "No idea.", None,
)
#: Of each answer: facts present, supported and cited, citations of unknown segments and of the forbidden document 30.
_SCORES = ((2, 2, 2, 0, 0), (2, 2, 1, 0, 0), (2, 2, 2, 0, 1), (2, 2, 1, 1, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0))


@query(f"""WITH s(i, present, supported, cited, unknown, cites_third) AS (VALUES {', '.join(f'({i}, {", ".join(map(str, x))})' for i, x in enumerate(_SCORES))}),
c AS (SELECT event_id AS case_id, user_id % 3 = 0 AS bad, user_id % 4 = 0 AS lacks, event_id % 5 <> 0 AS behaves, s.* FROM events JOIN s ON s.i = event_id % 6),
d AS (SELECT case_id, behaves, 2 AS facts_total, present, supported, cited, unknown, CASE WHEN bad THEN cites_third ELSE 0 END AS forbidden_cited, bad::INT AS forbidden_shown, lacks::INT AS required_missing FROM c)
SELECT * EXCLUDE behaves, behaves AND cited = 2 AND supported = 2 AND unknown + forbidden_cited + forbidden_shown + required_missing = 0 AS passed FROM d""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six answers over three segments, dealt to all events, with a third of them forbidden to show the third document."""
    e, u = F.col("event_id"), F.col("user_id")
    segment = lambda i, text: F.struct(F.lit(i).cast("long").alias("document_id"), F.lit(text).alias("text"))
    fact = lambda pattern, *ids: F.struct(F.lit(pattern).alias("pattern"), F.array(*(F.lit(i).cast("long") for i in ids)).alias("evidence"))
    long = lambda *ids: F.array(*(F.lit(i).cast("long") for i in ids))
    cases = A.table(spark, sf_dir, "events").select(
        e.alias("case_id"), _of(e, *_SAID).alias("answer"), (e % 5 != 0).alias("behaves"),
        F.array(segment(10, "a renewal of the tunnel's certificate"), segment(20, "Restart it afterwards"), segment(30, "gossip")).alias("injected"),
        F.array(fact("renewal", 10), fact("(?i)restart", 20, 30)).alias("facts"), F.when(u % 4 == 0, long(10, 40)).otherwise(long(10)).alias("required"), F.when(u % 3 == 0, long(30)).alias("forbidden"),
    )
    return E.scored_answers(cases)


@query("SELECT source, count(*) FILTER (WHERE doc_id % 7 = 0) AS added, count(*) FILTER (WHERE doc_id % 7 IN (1, 2)) AS updated, count(*) FILTER (WHERE doc_id % 7 = 3) AS deleted, count(*) FILTER (WHERE doc_id % 7 > 4) AS skipped, count(*) FILTER (WHERE doc_id % 7 = 4) AS failed, min(doc_id) FILTER (WHERE doc_id % 7 = 4) AS first_failed FROM documents GROUP BY source")
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = _of(F.col("doc_id"), "added", "updated", "updated", "deleted", "failed", "skipped", "skipped")
    docs = A.table(spark, sf_dir, "documents").select("source", "doc_id", change.alias("change"))
    kinds = ("added", "updated", "deleted", "skipped", "failed")
    return docs.groupBy("source").agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.min(F.when(F.col("change") == "failed", F.col("doc_id"))).alias("first_failed"))


@query("""WITH r AS (SELECT user_id % 40 AS bench, event_id AS trial, (value + 1) / (user_id % 3 + 1) AS ratio FROM events WHERE value IS NOT NULL AND event_id % 50 = user_id % 50),
n AS (SELECT bench, ratio, row_number() OVER (PARTITION BY bench ORDER BY trial) - 1 AS i FROM r), s AS (SELECT bench, count(*) AS pairs, median(ratio) AS ratio FROM n GROUP BY bench),
d AS (SELECT bench, resample, ('0x' || substr(md5('1749:' || resample || ':' || draw), 1, 8))::BIGINT % pairs AS i FROM s, (SELECT unnest(range(200)) AS resample), LATERAL (SELECT unnest(range(1, pairs + 1)) AS draw) WHERE pairs >= 3),
m AS (SELECT bench, resample, median(ratio) AS m FROM d JOIN n USING (bench, i) GROUP BY ALL), b AS (SELECT bench, quantile_disc(m, 0.025) AS low, quantile_disc(m, 0.975) AS high FROM m GROUP BY bench)
SELECT bench, pairs, ratio, low, high FROM s LEFT JOIN b USING (bench)""")
def speedup_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = A.table(spark, sf_dir, "events").where("event_id % 50 = user_id % 50")
    ratios = trials.select((F.col("user_id") % 40).alias("bench"), "event_id", ((F.col("value") + 1) / (F.col("user_id") % 3 + 1)).alias("ratio"))
    return M.ratio_bounds(ratios, "bench", "event_id", "ratio", resamples=200)
