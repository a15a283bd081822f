"""Rules as data: scans of texts for wording, verdicts, and intents of commands.

Rules become literal expressions of one projection, so that patterns are
compiled once and texts are read once; there is no join of rules with texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cases, let, s


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    patterns: tuple[str, ...]
    rx_only: bool = False
    patient_only: bool = False
    presence: bool = False


# The rules' names, severities and patterns, in order of report.
RULES = (
    Rule("ADV-16-CURE", "fatal", (r"根治|治愈率|有效率\s*(?:高达|达到)?\s*\d|保证治愈|彻底治愈|包治|药到病除|攻克癌症|治愈一切", r"100%\s*(?:有效|安全|治愈)")),
    Rule("ADV-16-SAFE", "fatal", (r"安全无(?:毒)?副作用|绝对安全|无毒副作用|零风险|无任何副作用",)),
    Rule("ADV-16-COMPARE", "warn", (r"优于\s*(?:所有|其他)\s*(?:药品|药物|竞品|治疗方案)|疗效(?:远)?优于|全面超越竞品", r"最好的\s*(?:药|治疗|方案)")),
    Rule("ADV-16-ENDORSE", "fatal", (r"(?:明星|代言人).{0,8}(?:推荐|代言)|患者现身说法|患者证言|用户反馈证实",)),
    Rule("ADV-09-ABSOLUTE", "warn", (r"国家级|世界级|最高级|最佳|最好|最强|最有效|最安全|最先进|最新技术|第一品牌|顶级|极品|全网第一|销量第一|史上最|独一无二|全球首创|全球第一|国内首创", r"(?i)NO\.?\s*1")),
    Rule("DRG-RX-PUBLIC", "fatal", (r"大众(?:媒介|媒体)|电视广告|短视频(?:平台)?投放|社交平台种草|朋友圈广告|电梯广告",), rx_only=True),
    Rule("DRG-INDUCE", "warn", (r"热销|抢购|限时优惠|买一送一|家庭必备|送礼佳品|无效退款|保险公司承保",)),
    Rule("MED-TECH-CLAIM", "warn", (r"最(?:新|先进)诊疗技术|尖端技术|国际领先技术|革命性突破|里程碑式治愈",)),
    Rule("MED-ENDORSE-ORG", "warn", (r"国家(?:机关|推荐)|卫建委推荐|药监局推荐|三甲医院(?:指定|联名)|中华医学会推荐|权威机构认证",)),
    Rule("PAT-PRODUCT-PROMO", "fatal", (r"处方药.{0,12}(?:广告|推广|宣传)|产品疗效宣传",), patient_only=True),
    Rule("PAT-DISCLAIMER", "info", (r"遵医嘱|在医生指导下|请咨询医生|专业诊疗建议|不能替代专业诊疗",), patient_only=True, presence=True),
    Rule("HCP-RDPAC-GIFT", "warn", (r"(?:向|为)(?:医生|HCP).{0,10}(?:赠送|礼品|提成|返点|旅游)|回扣|处方费",)),
)
NEGATION = "不得|禁止|不能|严禁|避免|不含|不可|勿|不得含|不使用|未获|无需"  #: fixed value: words that turn a hit into a statement of a ban
WINDOW = 16  #: characters before a hit in which they do
RANK = {"fatal": 0, "warn": 1, "info": 2}


def _hits(text: Column, pattern: str) -> Column:
    """Matches that no negation precedes or holds."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))

    def hits(p: Column) -> Column:
        def hit(m: Column, i: Column) -> Column:
            start = total(p["gaps"], i + 1) + total(p["found"], i)
            before = F.substring(text, F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW)))
            return F.when(~F.rlike(before, F.lit(NEGATION)) & ~F.rlike(m, F.lit(NEGATION)), m)

        return F.filter(F.transform(p["found"], hit), lambda m: m.isNotNull())

    return F.when(F.rlike(text, F.lit(pattern)), let(parts, hits)).otherwise(F.array().cast("array<string>"))


def _applies(rule: Rule, audience: Column, rx_status: Column) -> Column:
    ok = F.lit(True)
    if rule.rx_only:
        ok = ok & (rx_status == "rx")
    if rule.patient_only:
        ok = ok & (audience == "patient")
    return ok


def scan(df: DataFrame, keys: tuple[str, ...], text: Column, audience: Column, rx_status: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(keys, rule, severity, matched): a row for each hit of a wording rule that applies."""
    none = F.array().cast("array<struct<rule:string,severity:string,matched:string>>")
    x = df.withColumn("_text", s(text))
    parts = []
    for r in rules:
        if r.presence:
            continue
        every = F.flatten(F.array(*[_hits(F.col("_text"), p) for p in r.patterns]))
        named = F.transform(every, _named(r))
        parts.append(F.when(_applies(r, audience, rx_status), named).otherwise(none))
    return x.withColumn("_hits", F.concat(*parts)).where(F.size("_hits") > 0).select(*keys, F.explode("_hits").alias("h")).select(*keys, "h.*")


def _named(rule: Rule):
    return lambda m: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), m.alias("matched"))


def missing(df: DataFrame, by: str, text: Column, audience: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(by, rule, severity, matched empty): presence rules that no section of a whole fulfils."""
    out = None
    for r in (r for r in rules if r.presence):
        there = F.lit(False)
        for p in r.patterns:
            there = there | F.rlike(s(text), F.lit(p))
        one = df.where(_applies(r, audience, F.lit(""))).groupBy(by).agg(F.bool_or(there).alias("ok")).where("NOT ok")
        one = one.select(by, F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit("").alias("matched"))
        out = one if out is None else out.unionByName(one)
    return out


def verdicts(findings: DataFrame, wholes: DataFrame, by: str) -> DataFrame:
    """(by, fatal, warn, info, verdict) of every whole: fail with a fatal finding, warn with a warning, else pass."""
    n = findings.groupBy(by).agg(*[F.count_if(F.col("severity") == k).alias(k) for k in RANK])
    x = wholes.select(by).distinct().join(n, by, "left").select(by, *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in RANK])
    return x.withColumn("verdict", cases([(F.col("fatal") > 0, "fail"), (F.col("warn") > 0, "warn")], "pass"))


def annotations(findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, note): a section's findings as ``RULE[severity]``, by severity, then rule."""
    rank = cases([(F.col("severity") == k, v) for k, v in RANK.items()], 9)
    n = findings.groupBy(*keys, "rule", "severity").agg(F.count("*").alias("n")).withColumn("rank", rank)
    tag = F.array_repeat(F.concat("rule", F.lit("["), "severity", F.lit("]")), F.col("n").cast("int"))
    g = n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "rule", tag.alias("tags")))).alias("t"))
    return g.select(*keys, F.array_join(F.flatten(F.transform("t", lambda x: x["tags"])), " ").alias("note"))


# Patterns of commands, their intents, priorities and weights, in order.
INTENTS = (
    (r"^(?:test|测试|自检)\s*$", "test", 100, 1.0),
    (r"^(?:help|帮助|怎么用|怎么玩|功能)\s*$", "help", 100, 1.0),
    (r"^(?:评估|eval|skill|总结)", "eval_skills", 95, 0.9),
    (r"^(?:刷新|refresh|真值表|truth)", "refresh_truth", 95, 0.9),
    (r"^(?:升级|自升级|evolve|self-upgrade|cron-upgrade)\s*$", "cron_upgrade", 90, 1.0),
    (r"^(?:规范化|normalize|改名|重命名)\s*$", "normalize", 90, 1.0),
    (r"^(?:审计|audit|检查|校准|真伪)\s*$", "audit", 90, 1.0),
    (r"^(?:每日|推送|daily|跑批|cron)\s*$", "daily_push", 85, 1.0),
    (r"(?:这个\s*(?:pdf|PDF)\s*(?:是不是|是否)\s*(?:错配|错|对))", "verify_pdf_fulltext", 92, 0.95),
    (r"(?:我(?:下载了|给你的|发了)|提供|发了)(?:网页|截图|pdf|链接|文章|文献)?", "user_supplied_url", 92, 0.95),
    (r"(?:sci-hub|scihub|科学\s*hub)\s+(\S+)", "fetch_paper", 92, 0.95),
    (r"(?:验证|鉴定|真伪|check|audit)\s+(?:.*?\s+)?(/\S+\.pdf|\S+\.pdf)", "verify_pdf_metadata", 92, 0.95),
    (r"^(?:处理|跑|执行|process|看下|看)\s*(?:P?(\d+)-(\d+)|row\s*(\d+)|第?\s*(\d+)\s*(?:row|行|号)?)", "process_row", 80, 0.95),
    (r"^(?:找|搜|查|query|search)\s+(.+?)(?:\s+(?:最近|近|recent|new))?\s*(\d+)?\s*(?:天|day|周|week|月|month|篇)?\s*$", "search_papers", 75, 0.85),
    (r"^([A-Z][a-zA-Z-]+(?:\s+[A-Z]\.?)?)\s*(\d{4})?\s*(?:HCC|liver|肝|cancer|hepatocellular|论文|文献)?\s*$", "search_author_year", 60, 0.7),
    (r"^(?:记录|record|修正|改|错|应该是|改成)\s*(?:P?(\d+)-(\d+))?\s*(?:的\s*)?(\w+)?\s*(?:字段|field)?\s*[\"\']?(.+?)[\"\']?\s*(?:应该是|改成|→|->|to|=)\s*[\"\']?(.+?)[\"\']?$", "record_correction", 70, 0.95),
    (r"^(?:Row\s+)?P?(\d+)-(\d+)\s*(?:的\s*)?(\w+)?\s*(?:字段|field)?\s*[\"\']?(.+?)[\"\']?\s*(?:应该是|改成|→|->|to|=)\s*[\"\']?(.+?)[\"\']?$", "record_correction", 70, 0.95),
    (r"^(?:最近|recent|new)\s*(\d+)?\s*篇?", "recent_papers", 65, 0.8),
    (r"^(?:去重|dedup|重复|cleanup)", "dedup", 85, 0.9),
    (r"^(.+)$", "free_query", 0, 0.5),
)
SURE = 0.65  #: below this a model would have to confirm
SHORT_BONUS, SHORT_BYTES = 0.20, 10


def intent(text: Column, intents=INTENTS) -> Column:
    """(intent, score, unsure): the best pattern, of equals the first; a short text that matches as a whole gets a bonus."""
    t = F.trim(s(text))
    found = []
    for i, (pattern, name, priority, weight) in enumerate(intents):
        whole = (F.octet_length(t) <= SHORT_BYTES) & (F.regexp_extract(t, pattern, 0) == t)
        score = F.least(F.lit(priority / 100 * weight) + F.when(whole, SHORT_BONUS).otherwise(0.0), F.lit(1.0))
        found.append(F.when(F.rlike(t, F.lit(pattern)), F.struct(F.round(score, 9).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("intent"))))
    best = F.array_max(F.filter(F.array(*found), lambda f: f.isNotNull()))
    empty = (t == "") | best.isNull()
    score = F.when(empty, 0.0).otherwise(best["score"])
    return F.struct(F.when(empty, "free_query").otherwise(best["intent"]).alias("intent"), score.alias("score"), (score < SURE).alias("unsure"))
