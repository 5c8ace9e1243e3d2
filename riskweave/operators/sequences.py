"""Attack-chain detection: distinct anomaly types in a sliding window of events.

The window of an event is the time from the event to ``window_hours``
later, both ends included. A type is in that window exactly while the event lies
in [occurrence - window, occurrence] for some occurrence of the type. So per
(user, type) the occurrences become disjoint time intervals, each interval a +1
and a -1 on the user's time axis, and the state at an event is a running sum.
No window is ever gathered, and no pair of events is formed.

Most of a log can't hold a chain. So the time axis is cut into slices, a slice keeps a bit
mask of its types, and the union of the masks that a slice's windows may touch bounds what
they hold. Only events of slices whose bound allows a chain are looked at one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave.operators.timeline import slice_of
from riskweave.session import shared

# The anomaly types chain patterns are made of.
CHAIN_TYPES = [
    "reconnaissance", "privilege_escalation", "lateral_movement", "bulk_download",
    "impossible_travel", "brute_force", "successful_login",
]
BEFORE, AT, AFTER = 0, 1, 2  # order of rows that share a timestamp
SLICES = 24  # of a window: 300 seconds for two hours


def chain_pattern(present, kinds: Column) -> Column:
    """The first matching chain for a set of types; ``present(type)`` is its membership."""
    def every(*types: str) -> Column:
        return reduce(lambda a, b: a & b, [present(t) for t in types])

    return (
        F.when(every("reconnaissance", "privilege_escalation", "lateral_movement", "bulk_download"), "recon_to_exfil")
        .when(present("lateral_movement") & (kinds >= 2), "lateral_movement")
        .when(every("privilege_escalation", "reconnaissance"), "privilege_escalation_chain")
        .when(present("impossible_travel") & (kinds >= 2), "impossible_travel_sequence")
        .when(every("brute_force", "successful_login"), "brute_force_then_success")
    )


def possible_slices(cells: DataFrame, reach: int, min_types: int, count_blank: bool) -> DataFrame:
    """(user_id, slice) of the slices in which a chain may start: ``reach`` slices on are still in its windows.

    A chain type and the blank have a bit each; of other types the numbers in the slices are added
    up, which may count one twice and never misses one. Whether a set of types is a chain can only
    become true as the set grows, so a bound that is none rules the slice out.
    """
    bits = {t: 1 << k for k, t in enumerate(["", *CHAIN_TYPES] if count_blank else CHAIN_TYPES)}
    bit = F.create_map(*[F.lit(v) for pair in bits.items() for v in pair])[F.col("kind")]
    other = bit.isNull() & (F.lit(count_blank) | (F.col("kind") != ""))
    held = cells.groupBy("user_id", "slice").agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("mask"), F.count_if(other).alias("others"))
    # a user's slices are bounded by the time span, a frame by ``reach``
    ahead = W.partitionBy("user_id").orderBy("slice").rangeBetween(0, reach)
    bound = held.select("user_id", "slice", F.bit_or("mask").over(ahead).alias("mask"), F.sum("others").over(ahead).alias("others"))
    kinds = F.bit_count("mask") + F.col("others")
    chain = chain_pattern(lambda t: F.col("mask").bitwiseAND(bits[t]) > 0, kinds)
    return bound.where((kinds >= min_types) & chain.isNotNull()).select("user_id", "slice")


def time_cells(events: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Dated events (user_id, at, kind, slice), and the first and last time of each type in a slice of ``width`` seconds."""
    dated = events.where(F.col("ts").isNotNull()).select(
        "user_id", F.unix_micros("ts").alias("at"), F.col("anomaly_type").alias("kind"),
        slice_of(F.col("ts"), width).alias("slice"),
    )
    return dated, dated.groupBy("user_id", "slice", "kind").agg(F.min("at").alias("first"), F.max("at").alias("last"))


def attack_chains(
    events: DataFrame, window_hours: float = 2.0, min_types: int = 3, count_blank: bool = True
) -> DataFrame:
    """One row per user: pattern_detected, pattern_type, sequence_confidence.

    The most confident window wins, the earliest one on ties. ``count_blank``
    keeps events without an anomaly type as a type of their own.
    """
    window = int(window_hours * 3_600_000_000)
    # slices no longer than the window: inside one, equal types always touch
    if window_hours * 3600 < 1:
        raise ValueError("the window must be at least one second")
    width = max(1, int(window_hours * 3600) // SLICES)
    dated, cells = time_cells(events, width)
    cells = shared(cells)
    possible = shared(possible_slices(cells, -(-window // (width * 1_000_000)), min_types, count_blank))

    # intervals: a type's neighbouring cells merge unless more than the window apart
    own = W.partitionBy("user_id", "kind").orderBy("slice")  # rows bounded by the time span
    suspects = cells.join(possible.select(F.col("user_id").alias("_user")).distinct(), F.col("user_id").eqNullSafe(F.col("_user")), "left_semi")
    edges = suspects.withColumns({
        "opens": F.coalesce(F.col("first") - F.lag("last").over(own) > window, F.lit(True)),
        "closes": F.coalesce(F.lead("first").over(own) - F.col("last") > window, F.lit(True)),
    })
    if not count_blank:
        edges = edges.where(F.col("kind") != "")
    steps = edges.select("user_id", "kind", F.explode(F.array(
        F.when(F.col("opens"), F.struct((F.col("first") - window).alias("at"), F.lit(BEFORE).alias("turn"), F.lit(1).alias("step"))),
        F.when(F.col("closes"), F.struct(F.col("last").alias("at"), F.lit(AFTER).alias("turn"), F.lit(-1).alias("step"))),
    )).alias("e")).where("e is not null").select("user_id", "kind", "e.*")
    steps = steps.withColumn("slice", F.floor(F.col("at") / (width * 1_000_000)).cast("bigint"))
    state = {"kinds": F.col("step"), **{t: F.when(F.col("kind") == t, F.col("step")).otherwise(0) for t in CHAIN_TYPES}}
    names = list(state)
    steps = shared(steps.select("user_id", "slice", "at", "turn", *[c.alias(n) for n, c in state.items()]))

    # state carried into each slice in which a chain may start: one row per (user, slice)
    zeros = [F.lit(0).alias(n) for n in names]
    per_slice = (
        steps.select("user_id", "slice", F.lit(False).alias("possible"), *names)
        .unionByName(possible.select("user_id", "slice", F.lit(True).alias("possible"), *zeros))
        .groupBy("user_id", "slice")
        .agg(F.max("possible").alias("possible"), *[F.sum(n).cast("int").alias(n) for n in names])
    )
    earlier = W.partitionBy("user_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.withColumns({n: F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("int") for n in names})
    carried = carried.where("possible").select(
        "user_id", "slice", (F.col("slice") * (width * 1_000_000)).alias("at"), F.lit(-1).alias("turn"), *names
    )

    # running state at every distinct event time of these slices, inside (user, slice) only
    def there(rows: DataFrame) -> DataFrame:
        named = possible.toDF("_user", "_slice")
        return rows.join(named, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("slice") == F.col("_slice")), "left_semi")

    moments = there(dated).select("user_id", "slice", "at", F.lit(AT).alias("turn"), *zeros).distinct()
    along = W.partitionBy("user_id", "slice").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = carried.unionByName(there(steps)).unionByName(moments)
    rows = rows.withColumns({n: F.sum(n).over(along) for n in names}).where(F.col("turn") == AT)
    pattern = chain_pattern(lambda t: F.col(t) > 0, F.col("kinds"))
    rows = rows.withColumn("pattern", F.when(F.col("kinds") >= min_types, pattern))
    confidence = F.when(
        F.col("pattern").isNotNull(), F.least(F.lit(0.95), F.lit(0.5) + F.col("kinds") * F.lit(0.1))
    )
    found = rows.select("user_id", "at", "pattern", confidence.alias("confidence"))
    everyone = cells.select("user_id", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("double").alias("confidence")).distinct()
    return found.unionByName(everyone).groupBy("user_id").agg(
        F.max(F.col("pattern").isNotNull()).alias("pattern_detected"),
        F.max_by("pattern", F.when(F.col("pattern").isNotNull(), F.struct("confidence", -F.col("at")))).alias("pattern_type"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("sequence_confidence"),
    )
