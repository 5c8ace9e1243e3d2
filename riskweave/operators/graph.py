"""Privilege graph and blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.numbering import numbered
from riskweave.functions.salting import salted_left_join
from riskweave.operators.rules import holds_admin_permission
from riskweave.session import shared

SYSTEM_POINTS, RESOURCE_POINTS = 5, 15
#: Users whose edges are held by one task.
DEALT_USERS = 50_000


def _targets(items: Column, prefix: str, kind: str) -> Column:
    return F.transform(items, lambda x: F.struct(
        F.concat(F.lit(prefix), x).alias("target"), F.lit(kind).alias("type")))


def dealt(users: DataFrame) -> DataFrame:
    """The rows dealt by user in parts of about ``DEALT_USERS``.

    A compressed inventory of millions of users is read by a few tasks, which would hold the
    edges of all of theirs at once. A user's rows stay together, so edges of one user meet in one task.
    """
    return users.repartition(users.count() // DEALT_USERS + 1, "user_id")


def graph_edges(scored: DataFrame) -> DataFrame:
    """(source, target, type): user to role, user to system, user to resource."""
    edges = F.concat(
        _targets(F.col("roles"), "role:", "user_role"),
        _targets(F.filter(F.array("source_system"), lambda s: s != ""), "system:", "user_system"),
        _targets(F.col("permissions"), "resource:", "user_resource"),
    )
    return scored.select(F.col("user_id").alias("source"), F.explode(edges).alias("e")).select("source", "e.*")


def graph_nodes(scored: DataFrame) -> DataFrame:
    """(id, label, type, tier, score, shadow_admin); the last three for users only."""
    shadow = ~F.col("is_privileged") & (F.col("account_type") != "admin") & holds_admin_permission()
    users = scored.select(
        F.col("user_id").alias("id"), F.col("username").alias("label"), F.lit("user").alias("type"),
        "tier", "score", shadow.alias("shadow_admin"),
    )
    others = graph_edges(scored).select(F.col("target").alias("id"), F.col("type")).distinct()
    others = others.select(
        "id", F.regexp_extract("id", "^[a-z]+:(.*)$", 1).alias("label"),
        F.regexp_replace("type", "^user_", "").alias("type"),
    )
    return users.unionByName(others, allowMissingColumns=True)


# -- blast radius -----------------------------------------------------------

def _role_sets(users: DataFrame) -> DataFrame:
    """Users keyed by their sorted distinct roles; reach depends on nothing else."""
    return users.withColumn("role_set", F.array_sort(F.array_distinct("roles")))


def access_kinds(users: DataFrame) -> DataFrame:
    """(role_set, system, permission_set, n): the distinct kinds of access with their user counts.

    Expects one inventory row per user; users without roles reach nothing and are left out.
    """
    keyed = _role_sets(users).where(F.size("role_set") > 0)
    return keyed.groupBy(
        "role_set", F.col("source_system").alias("system"),
        F.array_sort(F.array_distinct("permissions")).alias("permission_set"),
    ).agg(F.count(F.lit(1)).alias("n"))


def role_systems(kinds: DataFrame) -> DataFrame:
    """(role, system): the systems in which a role is held, distinct."""
    pairs = kinds.select("role_set", "system").distinct()
    return pairs.select(F.explode("role_set").alias("role"), "system").distinct()


def role_set_reach(kinds: DataFrame) -> DataFrame:
    """(role_set, systems_at_risk): the systems reached over the set's roles.

    Runs on distinct role sets and (role, system) pairs and never on user rows.
    """
    set_roles = kinds.select("role_set").distinct().select("role_set", F.explode("role_set").alias("role"))
    reached = set_roles.join(role_systems(kinds), "role").groupBy("role_set")
    return reached.agg(F.array_sort(F.collect_set("system")).alias("systems_at_risk"))


def system_sets(reach: DataFrame, kinds: DataFrame) -> DataFrame:
    """(systems_at_risk, n, number): the distinct system sets, how many users reach each, and a dense number."""
    sizes = kinds.groupBy("role_set").agg(F.sum("n").alias("n"))
    return numbered(reach.join(sizes, "role_set").groupBy("systems_at_risk").agg(F.sum("n").alias("n")))


def set_resources(sets: DataFrame, kinds: DataFrame) -> DataFrame:
    """(systems_at_risk, sensitive_resources): the resources of a set's systems."""
    held = kinds.select("system", F.explode("permission_set").alias("resource")).distinct()
    met = sets.select("systems_at_risk", F.explode("systems_at_risk").alias("system")).join(held, "system")
    return met.groupBy("systems_at_risk").agg(F.array_sort(F.collect_set("resource")).alias("sensitive_resources"))


def downstream_counts(sets: DataFrame) -> DataFrame:
    """(systems_at_risk, reaching_users): how many users reach at least one system of each set.

    A system has bitmaps of the numbers of the sets that it is in. A set stands for ``n`` users,
    so there is one bitmap for each binary digit of ``n``, of the sets that have it: the sets
    that meet a given one are the union of its systems' bitmaps, and their users the sum of
    2^digit times the bits. Sets are never paired.
    """
    digits = F.expr("filter(sequence(0, 62), d -> shiftright(n, d) % 2 = 1)")
    placed = sets.select("systems_at_risk", (F.col("number") + 1).alias("place"), F.explode(digits).alias("digit"))
    placed = placed.select(F.explode("systems_at_risk").alias("system"), "digit", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    marks = placed.groupBy("system", "digit", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    asked = sets.select("number", F.explode("systems_at_risk").alias("system"))
    union = asked.join(marks, "system").groupBy("number", "digit", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("met"))
    users = union.groupBy("number").agg(F.sum(F.expr("shiftleft(met, digit)")).alias("reaching_users"))
    return sets.join(users, "number").select("systems_at_risk", "reaching_users")


def blast_radius(users: DataFrame) -> DataFrame:
    """Reach, downstream user count and impact for every identity in one job."""
    kinds = shared(access_kinds(users))
    reach = shared(role_set_reach(kinds))
    sets = system_sets(reach, kinds)
    reach = reach.join(set_resources(sets, kinds), "systems_at_risk", "left").join(downstream_counts(sets), "systems_at_risk", "left")
    out = salted_left_join(_role_sets(users), reach, ["role_set"], F.col("user_id"))
    none = F.array().cast("array<string>")
    systems, resources = F.coalesce("systems_at_risk", none), F.coalesce("sensitive_resources", none)
    downstream = F.coalesce(F.col("reaching_users") - 1, F.lit(0))
    impact = F.least(F.lit(100), F.size(systems) * SYSTEM_POINTS + F.size(resources) * RESOURCE_POINTS)
    first_two = F.array_join(F.slice(systems, 1, 2), ", ")
    text = F.concat(
        F.size(systems), F.lit(" systems ("), F.when(first_two != "", first_two).otherwise("none"), F.lit("), "),
        F.size(resources), F.lit(" resources and "), downstream, F.lit(" other users within reach"),
    )
    return out.select(
        F.col("user_id").alias("identity_id"), systems.alias("systems_at_risk"),
        resources.alias("sensitive_resources"), downstream.alias("downstream_user_count"),
        impact.alias("estimated_impact_score"), text.alias("narrative"),
    )


def downstream_users(users: DataFrame, identity_id: str) -> DataFrame:
    """The other users who reach any system one identity reaches: those who hold a role that is
    held in such a system. Only (user, role) rows meet the roles found."""
    held = role_systems(shared(access_kinds(users)))
    own = users.where(F.col("user_id") == identity_id).select(F.explode("roles").alias("role")).distinct()
    systems = held.join(own, "role", "left_semi").select("system").distinct()
    roles = held.join(systems, "system", "left_semi").select("role").distinct()
    others = users.where(F.col("user_id") != identity_id).select("user_id", F.explode(F.array_distinct("roles")).alias("role"))
    return others.join(roles, "role", "left_semi").select("user_id").distinct()
