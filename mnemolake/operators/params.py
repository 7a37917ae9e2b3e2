"""Parameter tables: overlay of scopes, gray variants, versions, rollback and change feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.core import hash_bucket
from mnemolake.operators.ordered import rank_in_key

COUNTED = ["category", "scope", "scope_id"]  # versions count up here, over all names
ENTRY = [*COUNTED, "name"]
LAYERS = ("global", "tenant", "user", "request")


def param_overlay(
    users: DataFrame, defaults: DataFrame, global_: DataFrame, tenant: DataFrame, user: DataFrame,
    request: DataFrame | None = None, barred: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Effective value per (user, category, param): default < global < tenant < user < request, and its layer.

    `users` asks for categories (tenant_id, user_id, category). Parameters are rows with dotted names, so deep
    merging is one value per name. `barred` maps a layer to the categories it may not set.
    """
    keys = ["category", "param"]
    named = {
        "default": (defaults.select(*keys, "value"), []),
        "global": (global_.select(*keys, "value"), []),
        "tenant": (tenant.select("tenant_id", *keys, "value"), ["tenant_id"]),
        "user": (user.select("user_id", *keys, "value"), ["user_id"]),
    }
    if request is not None:
        named["request"] = (request.select("user_id", *keys, "value"), ["user_id"])
    known = None
    for table, _ in named.values():
        known = table.select(*keys) if known is None else known.unionByName(table.select(*keys))
    grid = users.join(known.distinct(), "category")
    for layer, (table, scope) in named.items():
        grid = grid.join(table.withColumnRenamed("value", f"_{layer}"), [*scope, *keys], "left")
    for layer, categories in (barred or {}).items():
        blocked = F.col("category").isin(*categories)
        grid = grid.withColumn(f"_{layer}", F.when(~blocked, F.col(f"_{layer}")))
    order = [layer for layer in reversed([*named])]
    value = F.coalesce(*[F.col(f"_{layer}") for layer in order])
    source = F.coalesce(*[F.when(F.col(f"_{layer}").isNotNull(), F.lit(layer)) for layer in order])
    return grid.select(*users.columns, "param", value.alias("value"), source.alias("source")).filter(
        F.col("value").isNotNull()
    )


def rule_matches(now: Column) -> Column:
    """All given dimensions of a gray rule hold; a missing one passes."""
    tenant = F.col("tenant_in").isNull() | F.coalesce(F.array_contains("tenant_in", F.col("tenant_id")), F.lit(False))
    bucket = F.col("bucket_lt").isNull() | (hash_bucket(F.col("user_id"), 100) < F.col("bucket_lt"))
    share = F.col("traffic_pct").isNull() | (hash_bucket(F.col("user_id"), 10000) < F.col("traffic_pct") * 100)
    time = (F.col("starts").isNull() | F.col("ends").isNull()) | now.between(F.col("starts"), F.col("ends"))
    tags = F.col("tag_in").isNull() | F.coalesce(F.arrays_overlap("tag_in", "tags"), F.lit(False))
    return tenant & bucket & share & time & tags


def variant_assign(users: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """First matching rule per user and category, in rule order; `base` when none matches.

    users: tenant_id, user_id, tags, category; rules: category, rule_order, variant and the dimensions.
    """
    matched = (
        users.join(rules, "category")
        .filter(rule_matches(now))
        .groupBy("tenant_id", "user_id", "category")
        .agg(F.min_by("variant", "rule_order").alias("variant"))
    )
    return users.join(matched, ["tenant_id", "user_id", "category"], "left").select(
        "tenant_id", "user_id", "category", F.coalesce("variant", F.lit("base")).alias("variant")
    )


def param_write(entries: DataFrame, writes: DataFrame, **chunking) -> DataFrame:
    """Writes as the next versions of their category and scope, in order of `updated_at` and `seq`; the first one is 1."""
    heads = entries.groupBy(*COUNTED).agg(F.max("version").alias("_head"))
    order = [F.col("updated_at"), F.col("seq")]
    ranked = rank_in_key(writes, COUNTED, order, "_place", **chunking)
    head = heads.select(*[F.col(c).alias(f"_h_{c}") for c in COUNTED], "_head")
    same = F.lit(True)
    for c in COUNTED:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    version = (F.coalesce("_head", F.lit(0)) + F.col("_place")).cast("int")
    return ranked.join(head, same, "left").withColumn("version", version).select(*entries.columns)


def param_history(entries: DataFrame) -> DataFrame:
    """All versions with the time each was archived, i.e. when the next version of its entry was written.

    The versions of an entry are ranked, also within a hot one, and the successor is an equi-join on the rank.
    """
    ranked = rank_in_key(entries, ENTRY, [F.col("version")], "_place")
    later = ranked.select(
        *[F.col(c).alias(f"_{c}") for c in ENTRY], (F.col("_place") - 1).alias("_v"),
        F.col("updated_at").alias("archived_at"),
    )
    same = (F.col("_place") == F.col("_v"))
    for c in ENTRY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.join(later, same, "left").select(
        *entries.columns, "archived_at", F.col("archived_at").isNull().alias("is_current")
    )


def param_rollback(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """New rows that repeat an archived version as the next version.

    requests: category, scope, scope_id, target_version, actor, at.
    """
    scope = COUNTED
    heads = entries.groupBy(*scope).agg(F.max("version").alias("_head"))
    wanted = requests.select(
        *[F.col(c).alias(f"_{c}") for c in scope], F.col("target_version"), F.col("actor").alias("_actor"), "at"
    )

    def same(df: DataFrame) -> Column:
        out = F.lit(True)
        for c in scope:
            out = out & df[c].eqNullSafe(F.col(f"_{c}"))
        return out

    target = entries.join(wanted, same(entries) & (F.col("version") == F.col("target_version")))
    head = heads.select(*[F.col(c).alias(f"_h_{c}") for c in scope], "_head")
    joined = target.join(
        head,
        F.col("category").eqNullSafe(F.col("_h_category")) & F.col("scope").eqNullSafe(F.col("_h_scope"))
        & F.col("scope_id").eqNullSafe(F.col("_h_scope_id")),
    ).filter(F.col("version") < F.col("_head"))
    actor = F.concat(F.col("_actor"), F.lit("/rollback@v"), F.col("target_version").cast("string"))
    changed = {"version": F.col("_head") + 1, "updated_at": F.col("at"), "actor": actor}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in entries.columns])


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change events between two snapshots of the parameter table; rows without a category are dropped."""
    key = ["scope", "scope_id", "name"]
    a = old.filter(F.coalesce("category", F.lit("")) != "").select(
        "category", *key, F.col("version").alias("_old")
    )
    b = new.filter(F.coalesce("category", F.lit("")) != "").select("category", *key, "version", "actor")
    joined = b.join(a, ["category", *key], "left")
    operation = F.when(F.col("_old").isNull(), "insert").when(F.col("_old") != F.col("version"), "update")
    return joined.select("category", *key, "version", "actor", operation.alias("operation")).filter(
        F.col("operation").isNotNull()
    )


def change_events(changes: DataFrame) -> DataFrame:
    """Raw change rows (operation_type, document columns) to events; works on a stream as well."""
    return changes.filter(
        F.col("operation_type").isin("insert", "update", "replace") & (F.coalesce("category", F.lit("")) != "")
    ).select(
        "category", F.coalesce("scope", F.lit("global")).alias("scope"), "scope_id", "name",
        F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("actor", F.lit("system")).alias("actor"),
    )
