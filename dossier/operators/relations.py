"""Relations of the entities, their edge list, and walks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from dossier.sources.tables import scratch_path, shared_root


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """The table with its columns named ``<prefix>_<column>``."""
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def with_children(parents: DataFrame, children: DataFrame, column: str, parent: str, child: str, how: str = "left") -> DataFrame:
    """Every parent with each of its children (nulls without one); columns are named by side."""
    p, c = prefixed(parents, parent), prefixed(children, child)
    return p.join(c, F.col(f"{parent}_id") == F.col(f"{child}_{column}"), how)


def organization_evidence(organizations: DataFrame, evidence: DataFrame) -> DataFrame:
    return with_children(organizations, evidence, "organization_id", "organization", "evidence")


def organization_mappings(organizations: DataFrame, mappings: DataFrame) -> DataFrame:
    return with_children(organizations, mappings, "organization_id", "organization", "mapping")


def framework_versions(frameworks: DataFrame, versions: DataFrame) -> DataFrame:
    return with_children(frameworks, versions, "framework_id", "framework", "version")


def version_requirements(versions: DataFrame, requirements: DataFrame) -> DataFrame:
    return with_children(versions, requirements, "version_id", "version", "requirement")


def evidence_mappings(evidence: DataFrame, mappings: DataFrame) -> DataFrame:
    """The large join: texts are left out before the shuffle."""
    return with_children(evidence.drop("extracted_text"), mappings, "evidence_id", "evidence", "mapping")


def requirement_mappings(mappings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Every mapping with its requirement. Mappings without one do not take part in the join."""
    m, r = prefixed(mappings, "mapping"), prefixed(requirements, "requirement")
    linked = m.where("mapping_requirement_id IS NOT NULL").join(r, F.col("mapping_requirement_id") == F.col("requirement_id"), "left")
    return linked.unionByName(m.where("mapping_requirement_id IS NULL"), allowMissingColumns=True)


def evidence_trace(organizations: DataFrame, evidence: DataFrame, mappings: DataFrame, requirements: DataFrame, versions: DataFrame, frameworks: DataFrame) -> DataFrame:
    """One flat row for each mapping: organization, evidence, mapping, requirement, version, framework."""
    chain = prefixed(requirements, "requirement").join(prefixed(versions, "version"), F.col("requirement_version_id") == F.col("version_id"), "left")
    chain = chain.join(prefixed(frameworks, "framework"), F.col("version_framework_id") == F.col("framework_id"), "left")
    m = prefixed(mappings, "mapping")
    m = m.join(prefixed(evidence.drop("extracted_text"), "evidence"), F.col("mapping_evidence_id") == F.col("evidence_id"), "left")
    m = m.join(prefixed(organizations, "organization"), F.col("mapping_organization_id") == F.col("organization_id"), "left")
    return m.join(chain, F.col("mapping_requirement_id") == F.col("requirement_id"), "left")


#: Edges: (source type, relation, destination type, table, source column, destination column).
RELATIONS = (
    ("organization", "has_evidence", "evidence", "evidence", "organization_id", "id"),
    ("organization", "has_mapping_for", "evidence", "mappings", "organization_id", "evidence_id"),
    ("organization", "maps_to", "requirement", "mappings", "organization_id", "requirement_id"),
    ("evidence", "supports", "requirement", "mappings", "evidence_id", "requirement_id"),
    ("framework", "has_version", "version", "versions", "framework_id", "id"),
    ("version", "has_requirement", "requirement", "requirements", "version_id", "id"),
)


def entity_edges(tables: dict[str, DataFrame], distinct: bool = True) -> DataFrame:
    """Edges (src_type, src_id, rel, dst_type, dst_id) of all relations, each once if ``distinct``; ids as text, nulls left out."""
    parts = []
    for src, rel, dst, table, a, b in RELATIONS:
        e = tables[table].select(F.lit(src).alias("src_type"), F.col(a).cast("string").alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst).alias("dst_type"), F.col(b).cast("string").alias("dst_id"))
        parts.append(e.where("src_id IS NOT NULL AND dst_id IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if distinct else out


#: Ids of a type in a frontier up to which they are broadcast; more are shuffled.
FRONTIER_ROWS = 1 << 19


def k_hop(edges: DataFrame | dict[str, DataFrame], seeds: DataFrame, k: int, through_hubs: tuple[str, ...] = ("evidence", "requirement", "version", "framework")) -> DataFrame:
    """type, id and hop of the nodes within ``k`` undirected hops of the seeds (type, id), at their smallest hop.

    Only nodes of the types ``through_hubs`` are expanded (seeds always are), as an organization reaches all it owns.
    ``edges`` is an edge list, stored once here, in which edges may come more than once; or the tables of ``RELATIONS`` by
    name. Of these a hop reads only such as link a type that it starts from, once for each such column, and keeps the
    rows that name a node of the frontier before any edge is made of them. A table that is dear to make should be
    ``stored`` first. Each round's frontier is checkpointed.
    """
    if isinstance(edges, DataFrame):
        edges = stored(edges.select("src_type", "src_id", "dst_type", "dst_id"))
    seen = frontier = checkpointed(seeds.select("type", F.col("id").cast("string").alias("id")).distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, k + 1):
        start = frontier.where("id IS NOT NULL").select("type", "id")
        if hop > 1:
            start = start.where(F.col("type").isin(*through_hubs))
        reached = _edges_beside(edges, start) if isinstance(edges, DataFrame) else _tables_beside(edges, start)
        if reached is None:
            break
        frontier = checkpointed(reached.distinct().join(seen, ["type", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def _edges_beside(edges: DataFrame, start: DataFrame) -> DataFrame | None:
    """The other ends (type, id) of the edges at ``start``; None if that is empty."""
    n = start.count()
    if not n:
        return None
    ends = [("src_type", "src_id", "dst_type", "dst_id"), ("dst_type", "dst_id", "src_type", "src_id")]
    forth, back = (edges.select(*(F.col(c).alias(name) for c, name in zip(e, ("a_type", "a_id", "type", "id")))) for e in ends)
    near = _dealt(start.select(F.col("type").alias("a_type"), F.col("id").alias("a_id")), n)
    return forth.unionByName(back).join(near, ["a_type", "a_id"], "left_semi").select("type", "id")


def _tables_beside(tables: dict[str, DataFrame], start: DataFrame) -> DataFrame | None:
    """The nodes (type, id) that rows of the tables link with ``start``; None if no table can have any."""
    kept = [r for r in RELATIONS if r[3] in tables]
    ends = [(t, a, ac, b, bc) for a, _, b, t, ac, bc in kept] + [(t, b, bc, a, ac) for a, _, b, t, ac, bc in kept]
    sizes = dict(start.where(F.col("type").isin(*{e[1] for e in ends})).groupBy("type").count().collect())
    out = None
    for table, kind, column in dict.fromkeys(e[:3] for e in ends if e[1] in sizes):
        others = list(dict.fromkeys(e[3:] for e in ends if e[:3] == (table, kind, column)))
        rows = tables[table].select(*dict.fromkeys([column, *(c for _, c in others)]))
        rows = _rows_of(rows, column, start.where(F.col("type") == kind).select("id"), sizes[kind])
        far = rows.select(F.inline(F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("id")) for t, c in others)))).where("id IS NOT NULL")
        out = far if out is None else out.unionByName(far)
    return out


def _rows_of(table: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows whose ``column``, as text, is one of the ``n`` ids. Whole numbers are compared as such, with those ids that are spelt as Spark spells numbers."""
    key, wanted = F.col(column).cast("string"), F.col("id")
    if isinstance(table.schema[column].dataType, IntegralType):
        key, wanted = F.col(column), F.col("id").try_cast(table.schema[column].dataType)
    near = _dealt(ids.where(wanted.cast("string") == F.col("id")).select(wanted.alias("frontier_id")), n)
    return table.join(near, key == F.col("frontier_id"), "left_semi")


def _dealt(near: DataFrame, n: int) -> DataFrame:
    return F.broadcast(near) if n <= FRONTIER_ROWS else near


def stored(df: DataFrame) -> DataFrame:
    """``df`` as files of the folder that all executors share."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
