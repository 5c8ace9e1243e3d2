"""Leaderboards, rollups and report tables over the scored identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave.functions import scalars as S
from riskweave.operators.remediation import identity_techniques
from riskweave.session import checkpointed
from riskweave.sources.sinks import LEADERBOARD_COLUMNS



def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("user_id").asc()]


# -- selection --------------------------------------------------------------

def leaderboard_filter(
    scored: DataFrame,
    tiers: list[str] | None = None,
    source_system: str | None = None,
    department: str | None = None,
    anomaly_type: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Case-insensitive filters; ``search`` looks inside username and email."""
    out = scored
    if tiers:
        out = out.where(F.col("tier").isin([t.upper() for t in tiers]))
    if source_system:
        out = out.where(F.lower("source_system") == source_system.lower())
    if department:
        out = out.where(F.lower("department") == department.lower())
    if anomaly_type:
        out = out.where(F.exists("anomaly_types", lambda a: F.upper(a) == anomaly_type.upper()))
    if search:
        term = search.lower()
        out = out.where(F.lower("username").contains(term) | F.lower("email").contains(term))
    return out


def identity_by_id(scored: DataFrame, user_id: str) -> DataFrame:
    return scored.where(F.col("user_id") == user_id)


def filter_values(scored: DataFrame) -> DataFrame:
    """Distinct values offered by each leaderboard filter."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value"))
                  for c in ("tier", "source_system", "department")]),
        F.transform("anomaly_types", lambda a: F.struct(F.lit("anomaly_type").alias("filter"), a.alias("value"))),
    )
    return scored.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").distinct()


def top_identities(scored: DataFrame, n: int) -> DataFrame:
    """The n riskiest identities with their rank; Spark keeps n rows per task."""
    top = scored.orderBy(*_order()).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*_order())))


def leaderboard_page(scored: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One 1-based page with its rank, as many rows as asked for. A deep page costs no more than the first."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    start = (page - 1) * page_size
    return rank_all(scored).where((F.col("rank") > start) & (F.col("rank") <= start + page_size))


def page_count(scored: DataFrame, page_size: int = 50) -> DataFrame:
    total = F.count(F.lit(1))
    return scored.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / page_size)).alias("pages"))


def rank_all(scored: DataFrame, partitions: int | None = None) -> DataFrame:
    """Global rank of every identity without a single-task sort.

    A range sort puts consecutive ranks in consecutive partitions; a row's rank
    is its place in the partition plus the sizes of the partitions before it.
    The sorted rows are checkpointed, so both steps see the same partitions.
    """
    n = partitions or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        scored.repartitionByRange(n, *_order())
        .sortWithinPartitions(*_order())
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = checkpointed(placed)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn("rank", F.col("__offset") + place + 1)
        .drop("__at", "__part", "__offset")
    )


def leaderboard_export(scored: DataFrame, **filters) -> DataFrame:
    """The filtered, ranked table with the columns of the CSV export."""
    ranked = rank_all(leaderboard_filter(scored, **filters))
    yes_no = F.when(F.col("blast_radius_applied"), "Yes").otherwise("No")
    return ranked.withColumn("blast_radius_applied", yes_no).select(*LEADERBOARD_COLUMNS)


def risk_scatter(scored: DataFrame, as_of: Column, cluster: Column | None = None) -> DataFrame:
    """Score against idle days; idle time stays null for accounts that never logged in."""
    idle = S.days_between(as_of, F.col("last_login"))
    return scored.select(
        "user_id", "username", "department", "tier", "score", idle.alias("days_since_login"),
        (cluster if cluster is not None else F.lit("N/A")).alias("cluster"),
        F.coalesce(idle > 120, F.lit(False)).alias("is_outlier"),
        F.col("tier").isin("CRITICAL", "HIGH").alias("marked"),
    )


# -- rollups ------------------------------------------------------------------

def tier_distribution(scored: DataFrame) -> DataFrame:
    """Count and percentage of every tier, absent tiers included. One row of partial sums per task."""
    tiers = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    total = F.count(F.lit(1))
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).alias("tier_order"), F.lit(t).alias("tier"),
            F.count_if(F.col("tier") == t).alias("identities"),
            (F.count_if(F.col("tier") == t) / F.greatest(total, F.lit(1)) * 100).alias("percentage"),
        )
        for i, t in enumerate(tiers)
    ])
    return scored.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def department_risk(scored: DataFrame) -> DataFrame:
    """Users, critical and high counts, mean score and weighted risk share per department."""
    n = F.count(F.lit(1))
    critical, high = F.count_if(F.col("tier") == "CRITICAL"), F.count_if(F.col("tier") == "HIGH")
    return scored.groupBy("department").agg(
        n.alias("user_count"), critical.alias("critical_count"), high.alias("high_count"),
        F.bround(F.avg("score"), 1).alias("avg_score"),
        F.bround((critical * 2 + high) / n * 100, 1).alias("risk_percentage"),
    )


def organization_risk(scored: DataFrame) -> DataFrame:
    """Mean score over everyone and the number of departments."""
    return scored.agg(
        F.count_distinct("department").alias("departments"), F.bround(F.avg("score"), 1).alias("organization_risk")
    )


def primary_rule_counts(scored: DataFrame, top: int = 8) -> DataFrame:
    counts = scored.where("primary_rule <> ''").groupBy("primary_rule").agg(F.count(F.lit(1)).alias("identities"))
    return counts.orderBy(F.desc("identities"), "primary_rule").limit(top)


def anomaly_type_counts(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("anomaly_types").alias("anomaly_type")).groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("identities"))


def technique_counts(scored: DataFrame) -> DataFrame:
    """Identities per technique they are first mapped to."""
    return scored.where("mitre_technique <> ''").groupBy("mitre_technique").agg(F.count(F.lit(1)).alias("identities"))


def technique_table(scored: DataFrame) -> DataFrame:
    """Techniques behind the primary rules of the scan, one row per (technique, rule)."""
    primary = scored.select(F.lit("-").alias("user_id"), "primary_rule").where("primary_rule <> ''").distinct()
    found = identity_techniques(primary.select("user_id", F.array("primary_rule").alias("contributing_factors")))
    return found.select("technique_id", "name", "tactic", "triggered_by_rule")


def remediation_sample(scored: DataFrame, identities: int = 20, per_identity: int = 2, rows: int = 10) -> DataFrame:
    """The first actions of the riskiest identities, as shown in the report."""
    actions = (
        top_identities(scored, identities)
        .select("rank", "user_id", F.posexplode(F.slice("remediation_actions", 1, per_identity)).alias("__p", "a"))
        .select("rank", "user_id", "a.*")
    )
    kept = actions.orderBy("rank", "priority").limit(rows)
    return kept.select(
        "rank", "user_id", "priority", "action_type",
        F.substring("human_readable_description", 1, 100).alias("description"), "expected_resolution_hours",
    )


def executive_summary(scored: DataFrame) -> DataFrame:
    t = F.col("tier")
    return scored.agg(
        F.count(F.lit(1)).alias("identities"),
        F.count_if(t == "CRITICAL").alias("critical"), F.count_if(t == "HIGH").alias("high"),
        F.count_if(t == "MEDIUM").alias("medium"), F.count_if(t == "LOW").alias("low"),
        F.avg("score").alias("avg_score"), F.avg("confidence").alias("avg_confidence"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    pending = ~F.coalesce("applied_to_retraining", F.lit(False))
    return feedback.agg(F.count(F.lit(1)).alias("total_corrections"), F.count_if(pending).alias("pending_corrections"))
