"""Precedence of rules, decisions and preferences; work items and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Scopes of a layer of their own, from broad to narrow.
BROAD = ("GLOBAL", "PROJECT")


def applicability(layers: list[list[tuple[str, str]]]) -> list[tuple[int, str, str]]:
    """(layer, scope kind, scope key) of layers of scopes, from broad to narrow, or a ValueError.

    GLOBAL and PROJECT stand alone and before all narrower scopes, GLOBAL first; there is one WORKSPACE at
    most, no scope twice, no empty layer.
    """
    seen: set[tuple[str, str]] = set()
    narrow, last = False, None
    for layer in layers:
        if not layer:
            raise ValueError("empty layer")
        for scope in layer:
            if scope in seen:
                raise ValueError(f"scope twice: {scope}")
            seen.add(scope)
        broad = next((kind for kind, _ in layer if kind in BROAD), None)
        if broad is None:
            narrow = True
            continue
        if len(layer) > 1:
            raise ValueError(f"{broad} needs a layer of its own")
        if narrow:
            raise ValueError(f"{broad} after a narrower scope")
        if last == "PROJECT" and broad == "GLOBAL":
            raise ValueError("GLOBAL after PROJECT")
        last = broad
    if sum(kind == "WORKSPACE" for kind, _ in seen) > 1:
        raise ValueError("more than one WORKSPACE")
    return [(i, kind, key) for i, layer in enumerate(layers) for kind, key in layer]


def _flag(df: DataFrame, keys: DataFrame | None, key: str, name: str) -> DataFrame:
    """df with whether its key is among ``keys`` (a table with the same column)."""
    if keys is None:
        return df.withColumn(name, F.lit(False))
    return df.join(keys.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def resolve_policies(policies: DataFrame, directives: DataFrame | None = None) -> DataFrame:
    """Outcome of each active rule.

    Protected ones are always kept if their source is trusted, else they conflict.  Rules without a key
    are kept.  Of a key, a directive of the request (policy_key) goes before all, unless a protected rule of the key
    rejects it; then the project tier before the user tier, then the largest layer; ties all stay, the
    rest is shadowed.
    """
    p = _flag(policies.where("status = 'ACTIVE'"), directives, "policy_key", "_asked")
    rank = F.when(F.col("tier") == "PROJECT", 1).otherwise(0) * 100 + F.col("layer")
    of_key = Window.partitionBy("policy_key")
    best = F.max(F.when(~F.col("protected") & F.col("policy_key").isNotNull(), rank)).over(of_key)
    guarded = F.coalesce(F.bool_or(F.col("protected") & F.col("trusted")).over(of_key), F.lit(False))
    outcome = (
        F.when(F.col("protected") & F.col("trusted"), "PROTECTED")
        .when(F.col("protected"), "CONFLICT")
        .when(F.col("policy_key").isNull(), "UNKEYED")
        .when(F.col("_asked") & ~guarded, "SHADOWED_BY_REQUEST")
        .when(rank == best, "SELECTED")
        .when((F.col("tier") == "USER") & (best >= 100), "SHADOWED_BY_TIER")
        .otherwise("SHADOWED_BY_LAYER")
    )
    return p.withColumn("outcome", outcome).drop("_asked")


def rejected_directives(policies: DataFrame, directives: DataFrame) -> DataFrame:
    """Directives (policy_key) that a protected rule with a trusted source rejects: each is a conflict."""
    guards = policies.where("status = 'ACTIVE' AND protected AND trusted AND policy_key IS NOT NULL").select("policy_key").distinct()
    return directives.select("policy_key").distinct().join(guards, "policy_key", "left_semi")


def resolve_decisions(decisions: DataFrame, directives: DataFrame | None = None) -> DataFrame:
    """Per topic the choice of its largest layer, or a conflict if that layer holds several choices.

    A topic that a directive of the request (topic) settles has no choice of its own: ``shadowed``.
    """
    d = decisions.where("status = 'ACTIVE'")
    top = F.max("layer").over(Window.partitionBy("topic"))
    n = d.withColumn("top", top).where("layer = top").groupBy("topic").agg(F.count_distinct("chosen").alias("choices"), F.min("chosen").alias("c"), F.count("*").alias("votes"))
    n = _flag(n, directives, "topic", "shadowed")
    return n.select("topic", F.when((F.col("choices") == 1) & ~F.col("shadowed"), F.col("c")).alias("chosen"), ((F.col("choices") > 1) & ~F.col("shadowed")).alias("conflict"), "votes", "shadowed")


def resolve_preferences(preferences: DataFrame, decisions: DataFrame, keys: list[str], directives: DataFrame | None = None) -> DataFrame:
    """Named preferences of the largest layer, or why they are shadowed: by a directive of the request
    (policy_key), else by a project decision of the same topic."""
    p = preferences.where(F.col("status") == "ACTIVE").where(F.col("policy_key").isin(keys))
    top = F.max("layer").over(Window.partitionBy("policy_key"))
    best = p.withColumn("top", top).where("layer = top").groupBy("policy_key").agg(F.count_distinct("rule_text").alias("values"), F.min("rule_text").alias("v"))
    best = _flag(_flag(best, directives, "policy_key", "_asked"), decisions.select(F.col("topic").alias("policy_key")), "policy_key", "_decided")
    shadow = F.when(F.col("_asked"), "SHADOWED_BY_REQUEST").when(F.col("_decided"), "SHADOWED_BY_DECISION")
    free = shadow.isNull()
    return best.select("policy_key", F.when(free & (F.col("values") == 1), F.col("v")).alias("value"), (free & (F.col("values") > 1)).alias("conflict"), shadow.alias("shadowed"))


def overlap_members(work_resources: DataFrame, role: str) -> DataFrame:
    """(resource_uid, work_uid, others) of every resource that several work items hold in a role.

    Two work items overlap if they have rows of the same resource.  The pairs, whose number grows with the
    square of a resource's holders, are not formed: ``others`` counts those of a row.
    """
    held = work_resources.where(F.col("role") == role).select("resource_uid", "work_uid").distinct()
    shared = held.groupBy("resource_uid").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return held.join(shared, "resource_uid").select("resource_uid", "work_uid", "others")


STATUSES = ("OPEN", "ACTIVE", "BLOCKED", "PAUSED", "COMPLETED", "ABANDONED")


def transition(status: Column, action: Column) -> Column:
    """The status after an action, or null if the action is not allowed there."""
    return (
        F.when((action == "START") & status.isin("OPEN", "PAUSED", "BLOCKED"), "ACTIVE")
        .when((action == "BLOCK") & (status == "ACTIVE"), "BLOCKED")
        .when((action == "PAUSE") & (status == "ACTIVE"), "PAUSED")
        .when((action == "COMPLETE") & (status == "ACTIVE"), "COMPLETED")
        .when((action == "ABANDON") & status.isin("OPEN", "ACTIVE", "BLOCKED", "PAUSED"), "ABANDONED")
    )


def staleness(status: Column, updated: Column, cutoff: Column) -> Column:
    return F.when(status.isin("COMPLETED", "ABANDONED"), "CLOSED").when(cutoff.isNull(), "NOT_EVALUATED").when(updated < cutoff, "POSSIBLY_STALE").otherwise("CURRENT")


def overlaps(work: DataFrame, resources: DataFrame, uid: int) -> DataFrame:
    """Open work of others on the resources of one item, with the roles of both sides, in order."""
    mine = resources.where(F.col("work_uid") == uid).groupBy("resource_uid").agg(F.array_sort(F.collect_set("role")).alias("this_roles"))
    live = work.where(F.col("status").isin("OPEN", "ACTIVE", "BLOCKED", "PAUSED") & (F.col("uid") != uid)).select(F.col("uid").alias("work_uid"), "status")
    other = resources.join(mine.select("resource_uid"), "resource_uid", "left_semi").join(live, "work_uid").groupBy("resource_uid", "work_uid", "status").agg(F.array_sort(F.collect_set("role")).alias("other_roles"))
    return other.join(mine, "resource_uid")


def by_status(work: DataFrame, limit: int) -> DataFrame:
    """The first items of each status, the statuses in order of the life of an item."""
    rank = F.lit(len(STATUSES))
    for i, s in enumerate(STATUSES):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    place = F.row_number().over(Window.partitionBy("status").orderBy("uid"))
    return work.withColumn("place", place).where(F.col("place") <= limit).withColumn("status_rank", rank)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key; at most one row a key is moved beyond the first aggregation."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")
    return rows.groupBy(key).agg(best).select("r.*")


def promote(notes: DataFrame, receipts: DataFrame) -> DataFrame:
    """What promoting each note does: NEW, REPLAY (same receipt and content) or CONFLICT (other content)."""
    j = notes.join(receipts.withColumnRenamed("digest", "known"), "receipt", "left")
    return j.withColumn("outcome", F.when(F.col("known").isNull(), "NEW").when(F.col("known") == F.col("digest"), "REPLAY").otherwise("CONFLICT"))


def layer_counts(policies: DataFrame) -> DataFrame:
    """Active rules and distinct keys of each layer and tier."""
    return policies.where("status = 'ACTIVE'").groupBy("layer", "tier").agg(F.count("*").alias("n"), F.count_distinct("policy_key").alias("keys"))


def lineage(links: DataFrame) -> DataFrame:
    """(uid, linked, kind, way): each row's links (from_uid, to_uid, kind) one step out and one step in."""
    out = links.select(F.col("from_uid").alias("uid"), F.col("to_uid").alias("linked"), "kind", F.lit("OUT").alias("way"))
    return out.unionByName(links.select(F.col("to_uid").alias("uid"), F.col("from_uid").alias("linked"), "kind", F.lit("IN").alias("way")))


def superseded(decisions: DataFrame) -> DataFrame:
    """(uid, status): active decisions that a later one of their topic stands above are SUPERSEDED."""
    last = decisions.groupBy("topic").agg(F.max("uid").alias("_last"))
    j = decisions.join(last, "topic")
    return j.select("uid", F.when((F.col("status") == "ACTIVE") & (F.col("uid") < F.col("_last")), "SUPERSEDED").otherwise(F.col("status")).alias("status"))


def work_snapshot(work: DataFrame, resources: DataFrame) -> DataFrame:
    """Work items with their number of resources and of roles."""
    r = resources.groupBy(F.col("work_uid").alias("uid")).agg(F.count("*").alias("resources"), F.count_distinct("role").alias("roles"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("resources", "roles")]
    return work.join(r, "uid", "left").select("uid", "status", *zero)
