"""Entity postings and the entity-memory graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.core import strip, unnest
from mnemolake.functions.text import extract_entities
from mnemolake.schemas import SCOPE
from mnemolake.session import sized

MENTIONS_CONFIDENCE = 0.9
MAX_HOPS = 3
MEMORY_PREFIX = "memory:"


def memory_node_id(cell: str) -> Column:
    return F.concat(F.lit(MEMORY_PREFIX), F.col(cell))


def entity_node_id(entity: str) -> Column:
    return F.concat_ws(":", F.lit("entity"), "tenant_id", "user_id", entity)


# --- entities of cells --------------------------------------------------------------------------------------------


def entity_source(cells: DataFrame, episodes: DataFrame) -> DataFrame:
    """Entities of a cell: the union over its episodes; when that is empty, the regex entities of its text."""
    listed = (
        episodes.select(*SCOPE, "mem_cell_id", F.explode("key_entities").alias("entity"))
        .select(*SCOPE, "mem_cell_id", strip(F.col("entity")).alias("entity"))
        .filter(F.col("entity") != "")
        .distinct()
    )
    bare = cells.join(listed.select(*SCOPE, "mem_cell_id"), [*SCOPE, "mem_cell_id"], "left_anti")
    drawn = unnest(bare, [*SCOPE, "mem_cell_id"], extract_entities(F.col("text")), "_i", "entity")
    return listed.unionByName(drawn.drop("_i"))


def cell_entities(cells: DataFrame, entities: Column) -> DataFrame:
    """scope, mem_cell_id, entity (trimmed, no blanks, exact-case distinct inside the row)."""
    clean = F.array_distinct(F.filter(F.transform(entities, strip), lambda e: e != ""))
    rest = [c for c in ("seq",) if c in cells.columns]
    return unnest(cells, [*SCOPE, "mem_cell_id", *rest], clean, "_i", "entity").drop("_i")


# --- inverted index -----------------------------------------------------------------------------------------------


def entity_postings(entities: DataFrame) -> DataFrame:
    """The inverted index as one row per (entity, scope, cell): a popular entity is many rows, never one long array."""
    return entities.select("entity", *SCOPE, "mem_cell_id").distinct()


def entity_index(entities: DataFrame) -> DataFrame:
    """Per (entity, scope): reference count, first and last cell; `seq` gives the latest update when present."""
    aggs = [F.count(F.lit(1)).alias("ref_count")]
    if "seq" in entities.columns:
        per_cell = entities.groupBy("entity", *SCOPE, "mem_cell_id").agg(F.max("seq").alias("seq"))
        aggs.append(F.max("seq").alias("updated_at"))
    else:
        per_cell = entity_postings(entities)
    return per_cell.groupBy("entity", *SCOPE).agg(*aggs)


def entity_lookup(postings: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct cell ids per (query_id, scope) of the wanted entities, lowest ids first."""
    found = (
        postings.select(*SCOPE, "entity", "mem_cell_id")
        .join(sized(wanted.select("query_id", *SCOPE, "entity").distinct()), [*SCOPE, "entity"])
        .select("query_id", *SCOPE, "mem_cell_id").distinct()
    )
    if limit is None:
        return found
    first = Window.partitionBy("query_id", *SCOPE).orderBy("mem_cell_id")
    return found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= limit).drop("_r")


def entity_remove_cell(postings: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings that stay, changed entities per removed cell)."""
    gone = removed.select(*SCOPE, "mem_cell_id").distinct()
    kept = postings.join(gone, [*SCOPE, "mem_cell_id"], "left_anti")
    changed = postings.join(gone, [*SCOPE, "mem_cell_id"], "left_semi").groupBy(*SCOPE, "mem_cell_id").agg(
        F.count(F.lit(1)).alias("changed")
    )
    return kept, changed


# --- nodes and edges ----------------------------------------------------------------------------------------------


def graph_nodes(entities: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Memory nodes and entity nodes. Every field follows from the id, so the last write equals any write."""
    memories = (cells if cells is not None else entities).select(*SCOPE, "mem_cell_id").distinct()
    memory = memories.select(
        memory_node_id("mem_cell_id").alias("node_id"), F.lit("memory").alias("node_type"), *SCOPE,
        F.col("mem_cell_id").alias("label"), F.col("mem_cell_id").alias("memory_id"), F.lit(True).alias("is_valid"),
    )
    entity = entities.select(*SCOPE, "entity").distinct().select(
        entity_node_id("entity").alias("node_id"), F.lit("entity").alias("node_type"), *SCOPE,
        F.col("entity").alias("label"), F.lit(None).cast("string").alias("memory_id"), F.lit(True).alias("is_valid"),
    )
    return memory.unionByName(entity)


def upsert_nodes(base: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Last write per (scope, node_id) wins; both sides carry `seq`."""
    rows = base.unionByName(incoming)
    rest = [c for c in rows.columns if c not in (*SCOPE, "node_id")]
    latest = rows.groupBy(*SCOPE, "node_id").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return latest.select(*SCOPE, "node_id", "_r.*").select(*rows.columns)


def graph_edges(entities: DataFrame) -> DataFrame:
    """MENTIONS edges memory -> entity. Each repeated mention adds 1 to the strength."""
    optional = [c for c in ("confidence", "is_valid", "seq") if c in entities.columns]
    confidence = F.max("confidence") if "confidence" in optional else F.lit(MENTIONS_CONFIDENCE)
    valid = F.lit(True)
    if "is_valid" in optional and "seq" in optional:
        valid = F.max_by("is_valid", "seq")
    grouped = entities.groupBy(*SCOPE, "mem_cell_id", "entity").agg(
        F.count(F.lit(1)).cast("double").alias("strength"), confidence.alias("confidence"), valid.alias("is_valid")
    )
    source, target = memory_node_id("mem_cell_id"), entity_node_id("entity")
    return grouped.select(
        F.concat(source, F.lit("|MENTIONS|"), target).alias("edge_id"), F.lit("MENTIONS").alias("edge_type"), *SCOPE,
        source.alias("source_node_id"), target.alias("target_node_id"), "confidence", "strength",
        F.array("mem_cell_id").alias("source_memory_ids"), "is_valid",
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("e"))
    e = edges.groupBy(*SCOPE).agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("e"))
    users = n.unionByName(e).groupBy(*SCOPE).agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return users.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


# --- traversal ----------------------------------------------------------------------------------------------------


def graph_traverse(
    seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2,
    edge_types: Iterable[str] | None = None, last_prefix: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Undirected BFS per query inside its scope, at most 3 hops.

    Seeds: query_id, scope, node_id. Invalid or unknown nodes are crossed but not returned; invalid edges are not
    crossed. Each hop is one equi-join on (scope, node) and one distinct; its frontier is written and counted, so a
    small one is broadcast to the edges where they lie and a large one is shuffled. The last hop only goes to nodes whose
    id starts with `last_prefix`, so a caller that wants memories does not pay for the entities behind them.
    """
    max_hops = max(0, min(MAX_HOPS, max_hops))
    usable = edges.filter("is_valid")
    wanted = [t.upper() for t in edge_types or []]
    if wanted:
        usable = usable.filter(F.upper("edge_type").isin(*wanted))
    ends = F.inline(
        F.array(
            F.struct(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("_to")),
            F.struct(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("_to")),
        )
    )
    steps = usable.select(*SCOPE, "edge_id", ends)
    at = ["query_id", *SCOPE, "node_id"]
    frontier = sized(seeds.select(*at).distinct())
    visited = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, max_hops + 1):
        ways = steps.filter(F.startswith("_to", F.lit(last_prefix))) if hop == max_hops and last_prefix else steps
        reached = (
            ways.join(frontier, [*SCOPE, "node_id"])
            .select("query_id", *SCOPE, F.col("_to").alias("node_id"))
            .distinct()
        )
        frontier = sized(reached.join(visited, at, "left_anti"))
        visited = visited.unionByName(frontier.withColumn("hop", F.lit(hop)))
    facts = nodes.filter("is_valid").select(*SCOPE, "node_id", "node_type", "label", "memory_id")
    crossed = (
        visited.filter(F.col("hop") < max_hops)
        .join(steps, [*SCOPE, "node_id"])
        .select("query_id", *SCOPE, "edge_id")
        .distinct()
    )
    return visited.join(facts, [*SCOPE, "node_id"]), crossed


def related_memories(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 2) -> DataFrame:
    """query_id, scope, entity -> memory ids within `max_depth` hops (1..3)."""
    seeds = wanted.select("query_id", *SCOPE, entity_node_id("entity").alias("node_id"))
    reached, _ = graph_traverse(seeds, nodes, edges, max(1, min(MAX_HOPS, max_depth)), last_prefix=MEMORY_PREFIX)
    memory = reached.filter(F.col("node_type") == "memory")
    return memory.select("query_id", *SCOPE, F.coalesce("memory_id", "label").alias("memory_id"), "hop")
