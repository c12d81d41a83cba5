"""The deterministic rules of the service desk as Column expressions and small dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import near_keyword

#: Scenarios with state, required fields and keywords.
SCENARIOS = [
    ("vpn", "active", ["device", "error_code"], ["VPN", "拨号失败", "无法建立连接", "证书", "800", "720"]),
    ("password", "coming", ["username"], ["密码", "忘记", "重置"]),
    ("email", "coming", [], ["邮箱", "邮件", "IMAP", "SMTP", "收不到", "发不出", "553", "554"]),
    ("software", "coming", [], ["软件", "激活", "许可证", "Office"]),
]
#: Greeting words, removed in this order.
GREETINGS = (
    "你好", "您好", "嗨", "哈喽", "hello", "hi", "hey", "在吗", "在不在", "早上好", "中午好", "下午好", "晚上好", "晚安",
    "谢谢", "感谢", "多谢", "再见", "拜拜", "打扰", "抱歉", "麻烦", "吗", "呢", "啊", "呀", "哦",
)
#: Solution rules (scenario, error code, certificate expired, action, risk).
RULES = [
    ("vpn", "800", True, "vpn.renew_certificate", "low"),
    ("vpn", "800", False, "vpn.check_client_config", "low"),
    ("vpn", "720", True, "vpn.rebuild_connection", "medium"),
]


def keywords(spark: SparkSession, scenarios: list = SCENARIOS) -> DataFrame:
    return spark.createDataFrame([(s[0], i, k) for s in scenarios for i, k in enumerate(s[3])], "scenario string, nth int, keyword string")


def spelled_intent(messages: DataFrame, words: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, scenario, matched: the only scenario with a keyword that the message contains or nearly contains."""
    hits = messages.select(key, text).crossJoin(F.broadcast(words)).withColumn("hit", near_keyword(F.col(text), F.col("keyword"))).where("hit is not null")
    matched = F.when(F.lower("keyword") == F.col("hit"), F.col("keyword")).otherwise(F.concat("keyword", F.lit("≈"), "hit"))
    found = hits.groupBy(key).agg(F.count_distinct("scenario").alias("n"), F.min("scenario").alias("scenario"), F.min_by(matched, "nth").alias("matched"))
    return found.where("n = 1").drop("n")


def several_problems(messages: DataFrame, words: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key and the scenarios of messages that name two or more."""
    hits = messages.select(key, text).crossJoin(F.broadcast(words)).where(F.contains(F.lower(text), F.lower("keyword")))
    return hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("scenario")), ",").alias("scenarios"), F.count_distinct("scenario").alias("n")).where("n >= 2").drop("n")


def missing_fields(required: list[str]) -> Column:
    """Names of the required fields that are null or empty."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in required)))


def route(error: Column, several: Column, request: Column, status: Column) -> Column:
    """Where a turn goes after the first round: error, several problems, greeting, question, active scenario, else the knowledge base."""
    return F.when(error, "handoff").when(several, "multi").when(request == "other", "greeting").when(request == "consult", "rag_query").when(status == "active", "check").otherwise("rag_query")


def after_verification(failed: Column, expired: Column) -> Column:
    return F.when(failed, "fail").when(expired, "expired").otherwise("valid")


def execution(matched: Column, risk: Column) -> Column:
    """auto only for a matched solution of low risk."""
    return F.when(matched & (F.coalesce(risk, F.lit("high")) == "low"), "auto").otherwise("human")


def solved(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Left join of the first rule for (scenario, error_code, cert_expired)."""
    keys = ["scenario", "error_code", "cert_expired"]
    first = rules.groupBy(*keys).agg(F.min_by(F.struct("action", "risk"), "nth").alias("rule"))
    return cases.join(F.broadcast(first), keys, "left").select("*", F.col("rule.action").alias("action"), F.col("rule.risk").alias("risk")).drop("rule")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "nth int, scenario string, error_code string, cert_expired boolean, action string, risk string")


def model_order(chain: Column, cursor: Column, blocked: Column) -> Column:
    """Models to try: rotated to the cursor, without blocked ones; the whole chain if all are blocked."""
    at = F.array_position(chain, cursor)
    turned = F.when(at > 0, F.concat(F.slice(chain, F.greatest(at, F.lit(1)).cast("int"), F.size(chain)), F.slice(chain, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))).otherwise(chain)
    alive = F.array_except(turned, blocked)
    return F.when(F.size(alive) > 0, alive).otherwise(chain)
