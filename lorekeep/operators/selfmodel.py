"""What the store knows of itself: health, coverage and trends, the vulnerabilities they show, and what to do about them.

Patterns have reward, effectiveness, reuse_count, created_days and updated_days (ages) and a domain. Statistics are one
aggregation over the patterns and one by domain; every rule works on those rows. Null numbers are left out of averages and
fall under no bound; an empty table has averages of zero and no vulnerability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# The bounds of the rules.
STALE_DAYS = 30
STALE_REUSE = 5
LOW_REWARD = 0.4
HIGH_REWARD = 0.8
COVERED = 0.6
EMBEDDED = 0.8
SEVERITIES = ("low", "medium", "high", "critical")

# What answers a category, with the priority at each severity, low to critical.
ANSWERS = {
    "knowledge_decay": ("refresh_stale_patterns", (3, 5, 8, 10), "refresh stale knowledge"),
    "low_embedding_coverage": ("generate_embeddings", (3, 5, 7, 9), "generate missing embeddings"),
    "coverage_gap": ("fill_coverage_gap", (7, 7, 7, 7), "improve {} knowledge coverage"),
    "quality_degradation": ("archive_low_quality", (2, 4, 7, 9), "improve pattern quality"),
    "overspecialization": ("research_topic", (3, 3, 3, 3), "diversify knowledge base"),
}


def health(patterns: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row over all patterns; embedded holds the ids (column id) that have a vector, repeats allowed."""
    has = embedded.select(c("id").alias("_vec")).where("_vec IS NOT NULL").distinct()
    p = patterns.join(has, c("id") == c("_vec"), "left")
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    since = lambda days: c("created_days") <= days
    little = c("reuse_count") < STALE_REUSE
    h = p.agg(
        F.count("*").alias("n"),
        mean("reward").alias("avg_reward"),
        mean("effectiveness").alias("avg_effectiveness"),
        F.coalesce(F.sum("reuse_count"), F.lit(0)).alias("total_reuse"),
        F.count_if(c("reward") >= HIGH_REWARD).alias("high"),
        F.count_if(c("reward") < LOW_REWARD).alias("low"),
        F.count("_vec").alias("embedded"),
        mean("created_days").alias("avg_age"),
        F.count_if((c("updated_days") > STALE_DAYS) & little).alias("stale"),
        F.count_if(since(7)).alias("n_week"),
        mean(F.when(since(7), c("reward"))).alias("week"),
        F.count_if(since(30)).alias("n_month"),
        mean(F.when(since(30), c("reward"))).alias("month"),
        F.count_if(c("updated_days").between(STALE_DAYS, STALE_DAYS + 7) & little).alias("decay"),
    )
    way = lambda x, e: F.when(c(x) > c("avg_reward") + e, "improving").when(c(x) < c("avg_reward") - e, "declining").otherwise("stable")
    return h.select("*", (c("n") - c("high") - c("low")).alias("medium"), (c("n_month") / 4.0).alias("growth"), way("week", 0.05).alias("week_trend"), way("month", 0.03).alias("month_trend"))


def coverage(patterns: DataFrame) -> DataFrame:
    """By domain: patterns, average reward and a score that grows with both."""
    reward = F.coalesce(F.avg("reward"), F.lit(0.0))
    return patterns.groupBy("domain").agg(F.count("*").alias("n"), (F.least(F.count("*") / 100.0, F.lit(1.0)) * (reward * 0.5 + 0.5)).alias("covered"))


def fixed(x: Column, places: int) -> Column:
    """A number that is not negative, with that many decimals, halves rounded up."""
    scaled = F.floor(x * 10**places + 0.5).cast("long")
    if not places:
        return scaled.cast("string")
    return F.concat(F.floor(scaled / 10**places).cast("string"), F.lit("."), F.lpad((scaled % 10**places).cast("string"), places, "0"))


def _finding(rule: int, category: str, holds: Column, severity: Column, domain: Column, impact: Column, reason: Column) -> Column:
    row = F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), severity.alias("level"), domain.alias("domain"), impact.alias("impact"), reason.alias("reason"))
    return F.when(holds, row)


def _rows(df: DataFrame, *findings: Column) -> DataFrame:
    return df.select(F.inline(F.array_compact(F.array(*findings))))


def vulnerabilities(patterns: DataFrame, embedded: DataFrame) -> DataFrame:
    """Each rule that holds, for the whole store or a domain: rule, category, level (1 low to 4 critical), severity, impact, reason.

    The domain with most patterns is the concentrated one, of equal ones the least name.
    """
    none = F.lit(None).cast("string")
    share = lambda x: c(x) / F.nullif(c("n"), F.lit(0))
    graded = lambda x, *steps: sum((F.when(x > s, 1).otherwise(0) for s in steps), F.lit(0))
    percent = lambda x: F.concat(F.lit("("), fixed(x * 100, 0), F.lit("%)"))
    stale, low, lacking = share("stale"), share("low"), 1 - share("embedded")
    whole = _rows(
        health(patterns, embedded),
        _finding(1, "knowledge_decay", stale > 0.2, 2 + graded(stale, 0.3, 0.5), none, stale, F.concat(c("stale"), F.lit(" patterns "), percent(stale), F.lit(" are stale"))),
        _finding(2, "low_embedding_coverage", share("embedded") < EMBEDDED, F.when(share("embedded") < 0.5, 3).otherwise(2), none, lacking, F.concat(c("n") - c("embedded"), F.lit(" patterns "), percent(lacking), F.lit(" missing embeddings"))),
        _finding(4, "quality_degradation", c("week_trend") == "declining", F.lit(2), none, F.lit(0.2), F.concat(F.lit("7d avg reward "), fixed(c("week"), 2), F.lit(" below overall"))),
        _finding(5, "quality_degradation", c("month_trend") == "declining", F.lit(3), none, F.lit(0.4), F.concat(F.lit("30d avg reward "), fixed(c("month"), 2), F.lit(" below overall"))),
        _finding(7, "quality_degradation", low > 0.3, 2 + graded(low, 0.5), none, low, F.concat(c("low"), F.lit(" patterns "), percent(low), F.lit(" have low reward"))),
    )
    by = coverage(patterns)
    gap = _finding(
        3, "coverage_gap", (c("covered") < COVERED) & (c("n") > 5), F.when(c("covered") < 0.3, 3).otherwise(2), c("domain"), 1 - c("covered"),
        F.concat(F.lit("Domain "), c("domain"), F.lit(" has low coverage "), fixed(c("covered") * 100, 1), F.lit("%")),
    )
    top = by.agg(F.count("*").alias("domains"), F.sum("n").alias("total"), F.min(F.struct((-c("n")).alias("less"), "domain")).alias("top"))
    most = -c("top.less") / F.nullif(c("total"), F.lit(0))
    narrow = _finding(6, "overspecialization", (c("domains") > 3) & (most > 0.7), F.lit(1), c("top.domain"), most - 0.5, F.concat(F.lit("Knowledge concentrated in "), c("top.domain"), F.lit(" "), percent(most)))
    rows = whole.unionByName(_rows(by, gap)).unionByName(_rows(top, narrow))
    return rows.withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), c("level").cast("int")))


def verdict(found: DataFrame) -> DataFrame:
    """One row: how many of each severity; the quick check's status, which any medium one raises, and the model's, which three do."""
    n = found.agg(*[F.count_if(c("level") == k + 1).alias(s) for k, s in enumerate(SEVERITIES)])
    grave = lambda warned: F.when(c("critical") > 0, "critical").when(c("high") > 1, "degraded").when(warned, "warning").otherwise("healthy")
    return n.select("*", grave(c("high") + c("medium") > 0).alias("quick_status"), grave((c("high") > 0) | (c("medium") > 2)).alias("status"))


def recommendations(found: DataFrame) -> DataFrame:
    """What to do, by falling priority, then severity, rule and domain; of neighbours in that order with one action only the first.

    Rows of one priority, severity and rule are neighbours, so they become one before the order is looked at: the window
    sees a row for each rule and severity, however many domains there are.
    """
    answer = lambda at: F.create_map(*[x for k, a in ANSWERS.items() for x in (F.lit(k), at(a))])[c("category")]
    priority = F.element_at(answer(lambda a: F.array(*map(F.lit, a[1]))), c("level").cast("int"))
    first = found.groupBy("rule", "category", "level").agg(F.min(F.struct("domain", "impact", "reason")).alias("f")).withColumn("priority", priority)
    w = Window.orderBy(F.desc("priority"), F.desc("level"), "rule")
    acts = first.withColumn("action", answer(lambda a: F.lit(a[0]))).withColumn("_before", F.lag("action").over(w))
    kept = acts.where("_before IS NULL OR _before <> action").withColumn("rank", F.row_number().over(w))
    goal = F.replace(answer(lambda a: F.lit(a[2])), F.lit("{}"), F.coalesce("f.domain", F.lit("")))
    return kept.select("rank", "priority", "action", c("f.domain").alias("domain"), c("f.impact").alias("benefit"), c("f.reason").alias("reason"), goal.alias("goal"))
