"""All queries of this library over the generated tables, each with the SQL that it is compared with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import schemas
from dossier.functions import exprs, text
from dossier.operators import audit, extract, lookup, mutate, relations, similarity
from dossier.plans import coverage, versions
from dossier.sources.database import read_entity, write_entity
from dossier.sources.objects import read_listed, write_objects
from dossier.sources.snapshots import Snapshots
from dossier.sources.tables import read_table, scratch_path, write_bucketed, write_table
from dossier.standin import Standin, with_views
from dossier.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "TIMESTAMP '2030-01-01 00:00:00'"


def _words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '[^{exprs.WHITE_SPACE}]+'))"


EXT = r"regexp_extract(lower({}), '[^/.][^/]*(\.[^/.]*)$', 1)"


def query(name: str, sql: str | None = None):
    """Registers a function of the views as a query."""

    def put(f: Callable[[Standin], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Standin(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put


def now():
    return F.expr(NOW)


# --- sources and lookups -------------------------------------------------------------------------------------

@query("land_objects", """SELECT file_path, upload_id, uploaded_at, md5(content) AS digest FROM (SELECT o_custkey AS file_path, o_orderkey AS upload_id, o_orderdate AS uploaded_at, CAST(o_orderkey AS VARCHAR) || o_orderstatus AS content,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(s):
    content = F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus").cast("binary")
    uploads = s.table("orders").select(F.col("o_custkey").alias("file_path"), F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("uploaded_at"), content.alias("content"))
    return mutate.land_objects(uploads).select("file_path", "upload_id", "uploaded_at", F.md5("content").alias("digest"))


@query("entity_tables", "SELECT CAST(id AS VARCHAR) AS id, name, TIMESTAMP '2030-01-01' AS created_at, TIMESTAMP '2030-01-01' AS updated_at FROM organizations")
def _(s):
    root = scratch_path(s.spark)
    write_table(s.organizations().withColumns({"created_at": now(), "updated_at": now()}), root, "organizations")
    return read_table(s.spark, root, "organizations")


@query("entity_database", """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN 'renamed ' || name ELSE name END AS name, TIMESTAMP '2030-01-01' AS created_at, TIMESTAMP '2030-01-01' AS updated_at
    FROM organizations WHERE id % 2 = 0""")
def _(s):
    """Organizations put into a database (the one that comes with Spark, in this process, its rows on disk), a third of them put again, and read back by a filter."""
    url = f"jdbc:derby:{tempfile.mkdtemp(prefix='spark-dossier-')}/db;create=true"
    rows = s.organizations().withColumns({"created_at": now(), "updated_at": now()})
    write_entity(rows, url, "organizations")
    write_entity(rows.where("id % 3 = 0").withColumn("name", F.concat(F.lit("renamed "), "name")), url, "organizations")
    return read_entity(s.spark, url, "organizations").where(F.substring("id", -1, 1).isin(*"02468"))


@query("document_response", """SELECT id, organization_id, file_path AS name, file_path, CAST(NULL AS INTEGER) AS file_size, mime_type, CAST(NULL AS VARCHAR) AS extracted_text,
    CAST(NULL AS INTEGER) AS page_count, CAST(NULL AS INTEGER) AS word_count, status, created_at, created_at AS updated_at FROM evidence""")
def _(s):
    full = lookup.with_missing(s.evidence(), {"file_size": "int", "extracted_text": "string", "page_count": "int", "word_count": "int"})
    return lookup.document_response(full.withColumns({"name": F.col("file_path"), "updated_at": F.col("created_at")}))


@query("get_by_id", "SELECT k.id, organization_id, file_path, status FROM (SELECT 3 * c_custkey AS id FROM customer) k LEFT JOIN evidence e ON k.id = e.id")
def _(s):
    keys = s.table("customer").select((3 * F.col("c_custkey")).alias("id"))
    return lookup.get_by_id(keys, s.evidence()).select("id", "organization_id", "file_path", "status")


@query("list_page", "SELECT id, status, created_at FROM evidence ORDER BY created_at, id LIMIT 100 OFFSET 200")
def _(s):
    return lookup.list_page(s.evidence(), 200, 100).select("id", "status", "created_at")


@query("list_after", "SELECT id, created_at FROM evidence WHERE (created_at, id) > (SELECT (created_at, id) FROM (SELECT created_at, id FROM evidence ORDER BY created_at, id LIMIT 1 OFFSET 99)) ORDER BY created_at, id LIMIT 100")
def _(s):
    last = lookup.list_page(s.evidence(), 99, 1).first()
    return lookup.list_after(s.evidence(), F.lit(last["created_at"]), F.lit(last["id"])).select("id", "created_at")


@query("evidence_by_organization", "SELECT organization_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at, id) AS rn FROM evidence) WHERE rn > 2 AND rn <= 7")
def _(s):
    return lookup.page_per_group(s.evidence(), "organization_id", 2, 5).select("organization_id", "id", F.col("rn").cast("bigint").alias("rn"))


_M_ORDER = ["created_at", "evidence_id", "requirement_id", "similarity_score", "status"]


@query("mappings_by_organization", """SELECT organization_id, evidence_id, requirement_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY organization_id
    ORDER BY created_at NULLS FIRST, evidence_id, requirement_id NULLS FIRST, similarity_score NULLS FIRST, status) AS rn FROM mappings) WHERE rn <= 10""")
def _(s):
    return lookup.page_per_group(s.mappings(), "organization_id", 0, 10, _M_ORDER).select("organization_id", "evidence_id", "requirement_id", F.col("rn").cast("bigint").alias("rn"))


@query("evidence_by_file_path", """SELECT organization_id, file_path, id FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, file_path ORDER BY created_at, id) AS rn FROM evidence)
    WHERE rn = 1 AND (organization_id, file_path) IN (SELECT o_custkey, 'f' || CAST(o_orderkey AS VARCHAR) || '.pdf' FROM orders)""")
def _(s):
    keys = s.table("orders").select(F.col("o_custkey").alias("organization_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_path"))
    return lookup.first_per_key(keys, s.evidence(), ["organization_id", "file_path"]).select("organization_id", "file_path", "id")


@query("mappings_by_evidence", "SELECT evidence_id, requirement_id, status FROM mappings WHERE evidence_id IN (SELECT 7 * c_custkey FROM customer)")
def _(s):
    keys = s.table("customer").select((7 * F.col("c_custkey")).alias("evidence_id"))
    return lookup.rows_by_key(keys, s.mappings(), ["evidence_id"]).select("evidence_id", "requirement_id", "status")


@query("mappings_by_requirement", "SELECT evidence_id, requirement_id, status FROM mappings WHERE requirement_id IN (SELECT 5 * s_suppkey FROM supplier)")
def _(s):
    keys = s.table("supplier").select((5 * F.col("s_suppkey")).alias("requirement_id"))
    return lookup.rows_by_key(keys, s.mappings(), ["requirement_id"]).select("evidence_id", "requirement_id", "status")


@query("organization_by_name", "SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM organizations) WHERE rn = 1 AND name IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier)")
def _(s):
    keys = s.table("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return lookup.first_per_key(keys, s.organizations(), ["name"])


@query("framework_by_name", "SELECT id, name FROM frameworks WHERE name IN (SELECT r_name FROM region WHERE r_regionkey <> 3)")
def _(s):
    keys = s.table("region").where("r_regionkey <> 3").select(F.col("r_name").alias("name"))
    return lookup.first_per_key(keys, s.frameworks(), ["name"])


@query("version_by_slug", "SELECT framework_id, version_slug, id FROM (SELECT *, row_number() OVER (PARTITION BY framework_id, version_slug ORDER BY id) AS rn FROM versions) WHERE rn = 1 AND version_slug IN ('v1', 'v3')")
def _(s):
    keys = s.versions().where("version_slug IN ('v1', 'v3')").select("framework_id", "version_slug")
    return lookup.first_per_key(keys, s.versions(), ["framework_id", "version_slug"]).select("framework_id", "version_slug", "id")


@query("versions_by_framework", "SELECT id, framework_id, version_slug, CAST(publication_date AS VARCHAR) AS publication_date, is_active FROM versions WHERE framework_id IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)")
def _(s):
    keys = s.table("region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("framework_id"))
    return lookup.rows_by_key(keys, s.versions(), ["framework_id"]).withColumn("publication_date", F.col("publication_date").cast("string"))


@query("requirement_by_code", "SELECT version_id, code, id FROM requirements WHERE code LIKE 'CC1_.1'")
def _(s):
    keys = s.requirements().where("code LIKE 'CC1_.1'").select("version_id", "code")
    return lookup.first_per_key(keys, s.requirements(), ["version_id", "code"]).select("version_id", "code", "id")


@query("requirements_by_version", "SELECT version_id, id, code, title FROM requirements WHERE version_id IN (SELECT id FROM versions WHERE version_slug = 'v2')")
def _(s):
    keys = s.versions().where("version_slug = 'v2'").select(F.col("id").alias("version_id"))
    return lookup.rows_by_key(keys, s.requirements(), ["version_id"]).select("version_id", "id", "code", "title")


_ALLOWED = f"({EXT.format('file_path')} IN ('.pdf', '.docx', '.txt') OR coalesce(mime_type IN ('application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/plain'), false))"
_REASON = "'Invalid file type. Allowed types are: .docx, .pdf, .txt'"


@query("upload_allowed", f"SELECT id, {_ALLOWED} AS allowed, CASE WHEN NOT {_ALLOWED} THEN {_REASON} END AS reason FROM evidence")
def _(s):
    name, mime = F.col("file_path"), F.col("mime_type")
    return s.evidence().select("id", exprs.upload_allowed(name, mime).alias("allowed"), exprs.reject_reason(name, mime).alias("reason"))


@query("tenant_captured", "SELECT event_id, t AS tenant_id, coalesce(t <> '', false) AS captured FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'tenant-' || CAST(user_id AS VARCHAR) END AS t FROM events)")
def _(s):
    log = s.table("events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN concat('tenant-', user_id) END").alias("tenant_id"))
    return log.withColumn("captured", exprs.tenant_captured(F.col("tenant_id")))


@query("tenant_scope", "SELECT id, organization_id, status FROM evidence WHERE organization_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def _(s):
    tenants = s.table("customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("organization_id"))
    return lookup.tenant_scope(s.evidence(), tenants).select("id", "organization_id", "status")


# --- expressions ---------------------------------------------------------------------------------------------

@query("file_extension", f"SELECT id, {EXT.format('file_path')} AS ext FROM evidence")
def _(s):
    return s.evidence().select("id", exprs.file_extension(F.col("file_path")).alias("ext"))


@query("word_count", f"SELECT id, CAST({_words('extracted_text')} AS BIGINT) AS words FROM text_documents")
def _(s):
    return s.text_documents().select("id", exprs.word_count(F.col("extracted_text")).alias("words"))


@query("decode_text", "SELECT doc_id AS id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM documents")
def _(s):
    broken = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFE282"))).otherwise(F.unhex(F.lit(""))))
    rows = s.table("documents").select(F.col("doc_id").alias("id"), extract.decode_text(broken).alias("t"))
    return rows.select("id", F.md5(F.col("t").cast("binary")).alias("digest"), exprs.text_length(F.col("t")).alias("chars"))


@query("assemble_pages", "SELECT document_id, md5(coalesce(string_agg(page_text, chr(10) ORDER BY page_no, page_text) FILTER (page_text <> ''), '')) AS digest, count(*) AS page_count FROM document_pages GROUP BY document_id")
def _(s):
    return extract.assemble_pages(s.document_pages()).select("document_id", F.md5(F.col("text").cast("binary")).alias("digest"), "page_count")


@query("assemble_paragraphs", "SELECT document_id, md5(string_agg(page_text, chr(10) ORDER BY page_no, page_text)) AS digest, CAST(1 AS BIGINT) AS page_count FROM document_pages GROUP BY document_id")
def _(s):
    return extract.assemble_paragraphs(s.document_pages()).select("document_id", F.md5(F.col("text").cast("binary")).alias("digest"), "page_count")


_TITLE = "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'Title ' || CAST(id AS VARCHAR) END"


@query("display_name", f"SELECT id, coalesce(nullif({_TITLE}, ''), file_path, '') AS name FROM evidence")
def _(s):
    return s.evidence().select("id", exprs.display_name(F.expr(_TITLE.replace("VARCHAR", "STRING")), F.col("file_path")).alias("name"))


@query("status_view", "SELECT id, coalesce(nullif(upper(status), ''), 'PENDING') AS status FROM text_documents")
def _(s):
    return s.text_documents().select("id", exprs.status_view(F.col("status")).alias("status"))


_PREVIEW = "CASE WHEN coalesce(nullif(upper(status), ''), 'PENDING') = 'COMPLETED' AND length(extracted_text) > 0 THEN substr(extracted_text, 1, 300) END"


@query("text_preview", f"SELECT id, {_PREVIEW} AS preview FROM text_documents")
def _(s):
    return s.text_documents().select("id", exprs.text_preview(F.col("status"), F.col("extracted_text")).alias("preview"))


@query("text_length", "SELECT id, CAST(length(extracted_text) AS BIGINT) AS chars FROM text_documents")
def _(s):
    return s.text_documents().select("id", exprs.text_length(F.col("extracted_text")).alias("chars"))


_HEX = "md5(CAST(id AS VARCHAR))"
_DASHED = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21)"


@query("parse_uuid", f"SELECT id, CASE WHEN id % 4 <> 3 THEN {_DASHED.format(_HEX)} END AS uuid FROM organizations")
def _(s):
    plain = F.md5(F.col("id").cast("string").cast("binary"))
    form = F.when(F.col("id") % 4 == 0, F.upper(plain)).when(F.col("id") % 4 == 1, F.concat(F.lit("urn:uuid:"), plain)).when(F.col("id") % 4 == 2, F.concat(F.lit("{"), plain, F.lit("}"))).otherwise(F.substring(plain, 1, 31))
    return s.organizations().select("id", exprs.parse_uuid(form).alias("uuid"))


_KIND = f"CASE {EXT.format('file_path')} WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.txt' THEN 'txt' WHEN '.text' THEN 'txt' END"


@query("file_kind", f"SELECT id, {_KIND} AS kind, CASE WHEN {_KIND} IS NULL THEN 'Unsupported file extension: ' || {EXT.format('file_path')} END AS error FROM evidence")
def _(s):
    return s.evidence().select("id", exprs.file_kind(F.col("file_path")).alias("kind"), exprs.kind_error(F.col("file_path")).alias("error"))


# --- ingest, update, delete ----------------------------------------------------------------------------------

@query("ingest_uploads", f"""SELECT id AS document_id, CASE WHEN {_ALLOWED} THEN 'queued' ELSE 'rejected' END AS outcome, CASE WHEN {_ALLOWED} THEN coalesce(nullif({_TITLE}, ''), file_path) END AS name,
    CASE WHEN {_ALLOWED} THEN 'PENDING' END AS status, CASE WHEN NOT {_ALLOWED} THEN {_REASON} END AS reason FROM evidence""")
def _(s):
    manifest = s.evidence().select(F.col("id").alias("document_id"), "organization_id", F.col("file_path").alias("filename"), F.col("mime_type").alias("content_type"), F.expr(_TITLE.replace("VARCHAR", "STRING")).alias("title"))
    rejected, artifacts, tasks = mutate.ingest_uploads(manifest, now())
    done = artifacts.join(tasks.select(F.col("document_id").alias("id"), F.col("status").alias("outcome")), "id").select(F.col("id").alias("document_id"), "outcome", "name", "status")
    return done.unionByName(rejected.select("document_id", F.lit("rejected").alias("outcome"), "reason"), allowMissingColumns=True)


def _tasks_and_objects(s: Standin):
    docs = s.text_documents()
    return docs.select(F.col("id").alias("document_id"), "file_path"), docs.where("id % 10 <> 9").select("file_path", F.col("extracted_text").cast("binary").alias("content"))


_ERROR = f"CASE WHEN id % 10 = 9 THEN 'No object with key: ' || file_path WHEN {_KIND} IS NULL THEN 'Unsupported file extension: ' || {EXT.format('file_path')} END"
_PROCESSED = f"""SELECT id AS document_id, error, CASE WHEN error IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN error IS NULL THEN 1 END AS page_count,
    CASE WHEN error IS NULL THEN CAST({_words('extracted_text')} AS INTEGER) END AS word_count, CASE WHEN error IS NULL THEN CAST(length(extracted_text) AS BIGINT) END AS text_length, CASE WHEN error IS NULL THEN md5(extracted_text) END AS digest
    FROM (SELECT *, {_ERROR} AS error FROM text_documents)"""


@query("process_documents", f"SELECT document_id, status, page_count, word_count, digest, error FROM ({_PROCESSED})")
def _(s):
    done = extract.process_documents(*_tasks_and_objects(s))
    return done.select("document_id", "status", "page_count", "word_count", F.md5(F.col("extracted_text").cast("binary")).alias("digest"), "error")


@query("process_result", f"SELECT document_id, status, page_count, word_count, text_length, error FROM ({_PROCESSED})")
def _(s):
    return extract.process_result(extract.process_documents(*_tasks_and_objects(s)))


def _updates(s: Standin) -> DataFrame:
    return s.status_log().select(F.col("document_id").alias("id"), "ts", "event_id", "status", F.expr("CASE WHEN event_id % 3 = 0 THEN concat('text ', event_id) WHEN event_id % 7 = 0 THEN '' END").alias("extracted_text"), F.expr("CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 4 AS INT) END").alias("page_count"), F.lit(None).cast("int").alias("word_count"))


def _artifacts(s: Standin) -> DataFrame:
    return s.text_documents().select("id", "status", F.col("file_path").alias("extracted_text"), F.lit(None).cast("int").alias("page_count"), F.lit(7).alias("word_count"), F.expr("TIMESTAMP '2000-01-01'").alias("updated_at"))


_FOLD = """SELECT document_id AS id, last(status ORDER BY ts, event_id) AS s, last(t ORDER BY ts, event_id) FILTER (t IS NOT NULL) AS t, last(p ORDER BY ts, event_id) FILTER (p IS NOT NULL) AS p
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'text ' || CAST(event_id AS VARCHAR) WHEN event_id % 7 = 0 THEN '' END AS t, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 4 AS INTEGER) END AS p FROM status_log) GROUP BY 1"""


_APPLIED = f"""SELECT d.id, coalesce(s, status) AS status, coalesce(t, file_path) AS extracted_text, p AS page_count, 7 AS word_count,
    CASE WHEN (s IS NOT NULL AND s IS DISTINCT FROM status) OR t IS NOT NULL OR p IS NOT NULL THEN {NOW} ELSE TIMESTAMP '2000-01-01' END AS updated_at FROM text_documents d LEFT JOIN ({_FOLD}) u ON d.id = u.id"""


@query("apply_status_updates", _APPLIED)
def _(s):
    return mutate.apply_status_updates(_artifacts(s), _updates(s), now(), ("ts", "event_id"))[0]


@query("snapshot_merge", _APPLIED)
def _(s):
    """The same updates merged into partitioned snapshots, texts stored by digest and read back."""
    snaps = Snapshots(s.spark, f"{scratch_path(s.spark)}/artifacts", 16, text_digits=1)
    snaps.write(_artifacts(s), 0)
    snaps.merge(snaps.put_texts(_updates(s), 1), 1, lambda rows, updates: mutate.apply_status_updates(rows, updates, now(), ("ts", "event_id"))[0])
    return snaps.read()


@query("unapplied_updates", "SELECT DISTINCT document_id AS id, document_id IN (SELECT id FROM text_documents) AS applied FROM status_log")
def _(s):
    return mutate.apply_status_updates(_artifacts(s), _updates(s), now(), ("ts", "event_id"))[1]


@query("update_rows", f"""SELECT e.id, CASE WHEN e.id % 2 = 0 THEN CASE WHEN e.id % 4 = 0 THEN NULL ELSE 'application/pdf' END ELSE mime_type END AS mime_type,
    CASE WHEN e.id % 2 = 0 AND CASE WHEN e.id % 4 = 0 THEN NULL ELSE 'application/pdf' END IS DISTINCT FROM mime_type THEN {NOW} ELSE created_at END AS updated_at FROM evidence e""")
def _(s):
    df = s.evidence().select("id", "mime_type", F.col("created_at").alias("updated_at"))
    patch = s.evidence().where("id % 2 = 0").select("id", F.expr("CASE WHEN id % 4 <> 0 THEN 'application/pdf' END").alias("mime_type"), F.lit(1).alias("no_such_field"))
    return mutate.update_rows(df, patch, now())


_NEW = """SELECT s_suppkey + 1000000000 AS id, CASE WHEN s_suppkey % 4 = 0 THEN replace(s_name, 'Supplier', 'Customer') WHEN s_suppkey % 4 = 1 THEN 'same ' || CAST(s_suppkey % 7 AS VARCHAR) ELSE s_name END AS name FROM supplier"""


@query("create_rows", f"""SELECT id, name, CASE WHEN rn = 1 AND name NOT IN (SELECT name FROM organizations) THEN 'created' ELSE 'rejected' END AS outcome, {NOW} AS created_at
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM ({_NEW}))""")
def _(s):
    new = s.table("supplier").select((F.col("s_suppkey") + 1000000000).alias("id"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN replace(s_name, 'Supplier', 'Customer') WHEN s_suppkey % 4 = 1 THEN concat('same ', s_suppkey % 7) ELSE s_name END").alias("name"))
    created, rejected = mutate.create_rows(s.organizations().withColumns({"created_at": now(), "updated_at": now()}), new, "organizations", now())
    return created.withColumn("outcome", F.lit("created")).unionByName(rejected.withColumn("outcome", F.lit("rejected"))).select("id", "name", "outcome", "created_at")


def _entities(s: Standin) -> dict[str, DataFrame]:
    mappings = s.mappings().withColumn("id", F.concat_ws("|", "evidence_id", F.coalesce(F.col("requirement_id").cast("string"), F.lit("-"))))
    return {"organizations": s.organizations(), "evidence_artifacts": s.evidence(), "compliance_mappings": mappings, "regulatory_frameworks": s.frameworks(), "regulatory_versions": s.versions(), "regulatory_requirements": s.requirements()}


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("delete_cascade", """SELECT 'organizations' AS name, count(*) AS n FROM organizations WHERE id % 3 <> 0 UNION ALL SELECT 'evidence_artifacts', count(*) FROM evidence WHERE organization_id % 3 <> 0
    UNION ALL SELECT 'compliance_mappings', count(*) FROM mappings WHERE organization_id % 3 <> 0 UNION ALL SELECT 'regulatory_frameworks', count(*) FROM frameworks
    UNION ALL SELECT 'regulatory_versions', count(*) FROM versions UNION ALL SELECT 'regulatory_requirements', count(*) FROM requirements""")
def _(s):
    return _counts(mutate.delete_cascade(_entities(s), "organizations", s.organizations().where("id % 3 = 0").select("id"))[0])


@query("delete_framework_cascade", """SELECT 'organizations' AS name, count(*) AS n FROM organizations UNION ALL SELECT 'evidence_artifacts', count(*) FROM evidence
    UNION ALL SELECT 'compliance_mappings', count(*) FROM mappings WHERE requirement_id IS NULL OR requirement_id NOT IN (SELECT id FROM requirements WHERE version_id IN (SELECT id FROM versions WHERE framework_id = 1))
    UNION ALL SELECT 'regulatory_frameworks', count(*) FROM frameworks WHERE id <> 1 UNION ALL SELECT 'regulatory_versions', count(*) FROM versions WHERE framework_id <> 1
    UNION ALL SELECT 'regulatory_requirements', count(*) FROM requirements WHERE version_id NOT IN (SELECT id FROM versions WHERE framework_id = 1)""")
def _(s):
    return _counts(mutate.delete_cascade(_entities(s), "regulatory_frameworks", s.frameworks().where("id = 1").select("id"))[0])


@query("delete_requirement_set_null", "SELECT evidence_id, CASE WHEN requirement_id % 2 = 1 THEN requirement_id END AS requirement_id, status FROM mappings")
def _(s):
    gone = s.requirements().where("id % 2 = 0").select("id")
    return mutate.delete_requirement_set_null(_entities(s), gone, "db")[0]["compliance_mappings"].select("evidence_id", "requirement_id", "status")


@query("document_status", f"""SELECT k.id AS document_id, d.id IS NOT NULL AS found, CASE WHEN d.id IS NULL THEN 'Document with ID ''' || CAST(k.id AS VARCHAR) || ''' not found.' END AS message,
    CASE WHEN d.id IS NOT NULL THEN coalesce(nullif(upper(status), ''), 'PENDING') END AS status, {_PREVIEW} AS text_preview, CASE WHEN d.id IS NOT NULL THEN 1 END AS page_count, {_words('extracted_text')} AS word_count
    FROM (SELECT DISTINCT user_id AS id FROM events) k LEFT JOIN text_documents d ON k.id = d.id""")
def _(s):
    ids = s.table("events").select(F.col("user_id").alias("id")).distinct()
    docs = s.text_documents().withColumns({"page_count": F.lit(1), "word_count": exprs.word_count(F.col("extracted_text"))})
    return mutate.document_status(ids, docs)


_LATEST = "SELECT document_id, last(status ORDER BY ts, event_id) AS status, last(ts ORDER BY ts, event_id) AS since FROM status_log GROUP BY document_id"


@query("latest_status", _LATEST)
def _(s):
    return mutate.latest_status(s.status_log())


@query("stuck_documents", f"SELECT document_id AS id, since AS updated_at FROM ({_LATEST}) WHERE status = 'PROCESSING' AND since < (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND")
def _(s):
    last = s.table("events").agg(F.max("ts")).first()[0]
    rows = mutate.latest_status(s.status_log()).select(F.col("document_id").alias("id"), "status", F.col("since").alias("updated_at"))
    return mutate.stuck_documents(rows, F.lit(last).cast("timestamp")).select("id", "updated_at")


@query("object_reconciliation", """WITH a AS (SELECT 'k' || CAST(id % 5000 AS VARCHAR) AS p, organization_id FROM evidence), o AS (SELECT 'k' || CAST(p_partkey * 3 AS VARCHAR) AS p FROM part)
    SELECT 'missing_object' AS problem, p AS file_path, count(*) AS n FROM a WHERE p NOT IN (SELECT p FROM o) GROUP BY p UNION ALL SELECT 'orphan_object', p, count(*) FROM o WHERE p NOT IN (SELECT p FROM a) GROUP BY p
    UNION ALL SELECT 'shared_path', p, count(DISTINCT organization_id) FROM a GROUP BY p HAVING count(DISTINCT organization_id) > 1""")
def _(s):
    rows = s.evidence().select(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")).alias("file_path"), "organization_id")
    blobs = s.table("part").select(F.concat(F.lit("k"), (F.col("p_partkey") * 3).cast("string")).alias("file_path"))
    return mutate.object_reconciliation(rows, blobs)


# --- relations -----------------------------------------------------------------------------------------------

@query("organization_evidence", "SELECT o.id AS organization_id, o.name AS organization_name, e.id AS evidence_id, e.status AS evidence_status FROM organizations o LEFT JOIN evidence e ON o.id = e.organization_id")
def _(s):
    return relations.organization_evidence(s.organizations(), s.evidence()).select("organization_id", "organization_name", "evidence_id", "evidence_status")


@query("organization_mappings", "SELECT o.id AS organization_id, m.evidence_id AS mapping_evidence_id, m.requirement_id AS mapping_requirement_id, m.status AS mapping_status FROM organizations o LEFT JOIN mappings m ON o.id = m.organization_id")
def _(s):
    return relations.organization_mappings(s.organizations(), s.mappings()).select("organization_id", "mapping_evidence_id", "mapping_requirement_id", "mapping_status")


@query("framework_versions", "SELECT f.id AS framework_id, f.name AS framework_name, v.id AS version_id, v.version_slug AS version_version_slug FROM frameworks f LEFT JOIN versions v ON f.id = v.framework_id")
def _(s):
    return relations.framework_versions(s.frameworks(), s.versions()).select("framework_id", "framework_name", "version_id", "version_version_slug")


@query("version_requirements", "SELECT v.id AS version_id, r.id AS requirement_id, r.code AS requirement_code FROM versions v LEFT JOIN requirements r ON v.id = r.version_id")
def _(s):
    return relations.version_requirements(s.versions(), s.requirements()).select("version_id", "requirement_id", "requirement_code")


@query("evidence_mappings", "SELECT e.id AS evidence_id, e.status AS evidence_status, m.requirement_id AS mapping_requirement_id, m.status AS mapping_status FROM evidence e LEFT JOIN mappings m ON e.id = m.evidence_id")
def _(s):
    return relations.evidence_mappings(s.evidence(), s.mappings()).select("evidence_id", "evidence_status", "mapping_requirement_id", "mapping_status")


def _facts(s: Standin) -> tuple[DataFrame, DataFrame]:
    """Evidence and mappings as tables that are dealt alike."""
    root, name = scratch_path(s.spark), f"dossier_{uuid.uuid4().hex}"
    evidence = write_bucketed(s.evidence(), f"{name}_evidence", "id", 8, f"{root}/evidence")
    return evidence, write_bucketed(s.mappings(), f"{name}_mappings", "evidence_id", 8, f"{root}/mappings")


@query("bucketed_evidence_trace", """SELECT o.name AS organization_name, e.id AS evidence_id, e.status AS evidence_status, m.status AS mapping_status, r.code AS requirement_code, f.name AS framework_name
    FROM mappings m LEFT JOIN evidence e ON m.evidence_id = e.id LEFT JOIN organizations o ON m.organization_id = o.id LEFT JOIN requirements r ON m.requirement_id = r.id
    LEFT JOIN versions v ON r.version_id = v.id LEFT JOIN frameworks f ON v.framework_id = f.id""")
def _(s):
    """The trace over stored facts that need no shuffle to meet."""
    evidence, mappings = _facts(s)
    rows = relations.evidence_trace(s.organizations(), evidence, mappings, s.requirements(), s.versions(), s.frameworks())
    return rows.select("organization_name", "evidence_id", "evidence_status", "mapping_status", "requirement_code", "framework_name")


@query("requirement_mappings", "SELECT m.evidence_id AS mapping_evidence_id, m.requirement_id AS mapping_requirement_id, r.code AS requirement_code FROM mappings m LEFT JOIN requirements r ON m.requirement_id = r.id")
def _(s):
    return relations.requirement_mappings(s.mappings(), s.requirements()).select("mapping_evidence_id", "mapping_requirement_id", "requirement_code")


@query("evidence_trace", """SELECT o.name AS organization_name, e.id AS evidence_id, m.status AS mapping_status, r.code AS requirement_code, v.version_slug AS version_version_slug, f.name AS framework_name
    FROM mappings m LEFT JOIN evidence e ON m.evidence_id = e.id LEFT JOIN organizations o ON m.organization_id = o.id LEFT JOIN requirements r ON m.requirement_id = r.id
    LEFT JOIN versions v ON r.version_id = v.id LEFT JOIN frameworks f ON v.framework_id = f.id""")
def _(s):
    rows = relations.evidence_trace(s.organizations(), s.evidence(), s.mappings(), s.requirements(), s.versions(), s.frameworks())
    return rows.select("organization_name", "evidence_id", "mapping_status", "requirement_code", "version_version_slug", "framework_name")


_EDGES = """SELECT DISTINCT * FROM (SELECT 'organization' AS src_type, CAST(organization_id AS VARCHAR) AS src_id, 'has_evidence' AS rel, 'evidence' AS dst_type, CAST(id AS VARCHAR) AS dst_id FROM evidence
    UNION ALL SELECT 'organization', CAST(organization_id AS VARCHAR), 'has_mapping_for', 'evidence', CAST(evidence_id AS VARCHAR) FROM mappings
    UNION ALL SELECT 'organization', CAST(organization_id AS VARCHAR), 'maps_to', 'requirement', CAST(requirement_id AS VARCHAR) FROM mappings
    UNION ALL SELECT 'evidence', CAST(evidence_id AS VARCHAR), 'supports', 'requirement', CAST(requirement_id AS VARCHAR) FROM mappings
    UNION ALL SELECT 'framework', CAST(framework_id AS VARCHAR), 'has_version', 'version', CAST(id AS VARCHAR) FROM versions
    UNION ALL SELECT 'version', CAST(version_id AS VARCHAR), 'has_requirement', 'requirement', CAST(id AS VARCHAR) FROM requirements) WHERE src_id IS NOT NULL AND dst_id IS NOT NULL"""


def _linked(s: Standin) -> dict[str, DataFrame]:
    """The tables that relations link."""
    return {"evidence": s.evidence(), "mappings": s.mappings(), "versions": s.versions(), "requirements": s.requirements()}


@query("entity_edges", _EDGES)
def _(s):
    return relations.entity_edges(_linked(s))


@query("k_hop", f"""WITH ed AS ({_EDGES}), b AS (SELECT src_type AS t, src_id AS i, dst_type AS u, dst_id AS j FROM ed UNION ALL SELECT dst_type, dst_id, src_type, src_id FROM ed),
    h0 AS (SELECT 'version' AS t, CAST(id AS VARCHAR) AS i FROM versions WHERE NOT is_active), h1 AS (SELECT DISTINCT u AS t, j AS i FROM b JOIN h0 USING (t, i) EXCEPT SELECT * FROM h0),
    h2 AS (SELECT DISTINCT u AS t, j AS i FROM b JOIN h1 USING (t, i) WHERE t <> 'organization' EXCEPT SELECT * FROM h0 EXCEPT SELECT * FROM h1),
    h3 AS (SELECT DISTINCT u AS t, j AS i FROM b JOIN h2 USING (t, i) WHERE t <> 'organization' EXCEPT SELECT * FROM h0 EXCEPT SELECT * FROM h1 EXCEPT SELECT * FROM h2)
    SELECT t AS type, i AS id, 0 AS hop FROM h0 UNION ALL SELECT t, i, 1 FROM h1 UNION ALL SELECT t, i, 2 FROM h2 UNION ALL SELECT t, i, 3 FROM h3""")
def _(s):
    seeds = s.versions().where("NOT is_active").select(F.lit("version").alias("type"), "id")
    tables = _linked(s)
    tables["mappings"] = relations.stored(tables["mappings"].select("evidence_id", "organization_id", "requirement_id"))
    return relations.k_hop(tables, seeds, 3)


# --- audits --------------------------------------------------------------------------------------------------

_REPORT = "SELECT '{t}' AS \"table\", '{r}' AS rule, {k} AS key, {n} AS n_violations FROM ({q})"


@query("audit_unique", _REPORT.format(t="mappings", r="unique(evidence_id,requirement_id)", k="CAST(evidence_id AS VARCHAR) || '|' || CAST(requirement_id AS VARCHAR)", n="n", q="SELECT evidence_id, requirement_id, count(*) AS n FROM mappings WHERE requirement_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
    + " UNION ALL " + _REPORT.format(t="requirements", r="unique(title)", k="title", n="n", q="SELECT title, count(*) AS n FROM requirements GROUP BY 1 HAVING count(*) > 1"))
def _(s):
    rules = {"mappings": (("evidence_id", "requirement_id"),), "requirements": (("title",), ("version_id", "code"))}
    return audit.audit_unique({"mappings": s.mappings(), "requirements": s.requirements()}, rules)


#: Every foreign key of the views: table, column, parent. A partner is made up: the organization 300 ids after the claimed one, which the last ones lack.
_FOREIGN = (
    ("mappings", "organization_id", "organizations"), ("mappings", "claimed_organization_id", "organizations"), ("mappings", "partner_organization_id", "organizations"), ("mappings", "evidence_id", "evidence"),
    ("mappings", "requirement_id", "requirements"), ("evidence", "organization_id", "organizations"), ("versions", "framework_id", "frameworks"), ("requirements", "version_id", "versions"),
    ("text_documents", "organization_id", "organizations"), ("status_log", "document_id", "text_documents"), ("document_pages", "document_id", "text_documents"), ("evidence_vectors", "evidence_id", "evidence"),
    ("evidence_vectors", "organization_id", "organizations"), ("requirement_vectors", "requirement_id", "requirements"), ("requirement_vectors", "framework_id", "frameworks"),
)
_PARTNERS = "(SELECT *, claimed_organization_id + 300 AS partner_organization_id FROM mappings)"


@query("audit_foreign_keys", " UNION ALL ".join(_REPORT.format(t=t, r=f"foreign_key({c})", k=f"CAST({c} AS VARCHAR)", n="n", q=f"SELECT {c}, count(*) AS n FROM {_PARTNERS if t == 'mappings' else t} WHERE {c} NOT IN (SELECT id FROM {p}) GROUP BY 1") for t, c, p in _FOREIGN))
def _(s):
    tables = {t: getattr(s, t)() for t in dict.fromkeys(x for t, _, p in _FOREIGN for x in (t, p))}
    tables["mappings"] = tables["mappings"].withColumn("partner_organization_id", F.col("claimed_organization_id") + 300)
    return audit.audit_foreign_keys(tables, {t: tuple((c, p) for u, c, p in _FOREIGN if u == t) for t in tables})


@query("audit_not_null", _REPORT.format(t="mappings", r="not_null", k="k", n="n", q="SELECT 'requirement_id' AS k, count(*) AS n FROM mappings WHERE requirement_id IS NULL UNION ALL SELECT 'similarity_score', count(*) FROM mappings WHERE similarity_score IS NULL")
    + " UNION ALL " + _REPORT.format(t="evidence", r="not_null", k="'mime_type'", n="count(*)", q="SELECT 1 FROM evidence WHERE mime_type IS NULL"))
def _(s):
    rules = {"mappings": ["requirement_id", "similarity_score", "status"], "evidence": ["mime_type", "file_path"]}
    return audit.audit_not_null({"mappings": s.mappings(), "evidence": s.evidence()}, rules)


@query("audit_lengths", _REPORT.format(t="requirements", r="length", k="'code'", n="count(*)", q="SELECT 1 FROM requirements WHERE length(code) > 5"))
def _(s):
    return audit.audit_lengths({"requirements": s.requirements()}, {"requirements": {"title": 255, "code": 5}})


@query("audit_status_domain", _REPORT.format(t="text_documents", r="status", k="status", n="n", q="SELECT status, count(*) AS n FROM text_documents WHERE status NOT IN ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED') GROUP BY 1"))
def _(s):
    return audit.audit_status_domain({"text_documents": s.text_documents(), "mappings": s.mappings()}, {"text_documents": schemas.EVIDENCE_STATUSES, "mappings": schemas.MAPPING_STATUSES})


@query("audit_tenant_isolation", _REPORT.format(t="mappings", r="tenant_isolation", k="CAST(c AS VARCHAR)", n="n", q="SELECT claimed_organization_id AS c, count(*) AS n FROM mappings m JOIN evidence e ON m.evidence_id = e.id WHERE claimed_organization_id <> e.organization_id GROUP BY 1"))
def _(s):
    return audit.audit_tenant_isolation(s.mappings(), s.evidence(), "claimed_organization_id")


# --- similarity, coverage, versions --------------------------------------------------------------------------

@query("similarity_mappings", """SELECT organization_id, evidence_id, requirement_id, similarity_score, 'pending' AS status FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY similarity_score DESC, requirement_id) AS rn
    FROM (SELECT e.organization_id, e.evidence_id, r.requirement_id, round(list_cosine_similarity(e.v, r.v), 6) AS similarity_score FROM evidence_vectors e, requirement_vectors r)) WHERE rn <= 5 AND similarity_score >= 0.1""")
def _(s):
    return similarity.similarity_mappings(s.evidence_vectors(), s.requirement_vectors().withColumn("requirement_id", F.col("requirement_id").cast("bigint")), 5, 0.1)


def _asked(s: Standin) -> DataFrame:
    return s.organizations().select((F.col("id") % 5).cast("int").alias("framework_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 2000).cast("int")).alias("as_of"))


_AS_OF = """SELECT DISTINCT ON (k.framework_id, k.as_of) k.framework_id, k.as_of, v.id AS version_id, v.version_slug, v.publication_date FROM ({}) k
    LEFT JOIN versions v ON k.framework_id = v.framework_id AND v.is_active AND v.publication_date <= k.as_of ORDER BY k.framework_id, k.as_of, v.publication_date DESC NULLS LAST, v.version_slug DESC, v.id DESC"""


@query("version_as_of", "SELECT framework_id, CAST(as_of AS VARCHAR) AS as_of, version_id, version_slug, CAST(publication_date AS VARCHAR) AS publication_date FROM (" + _AS_OF.format("SELECT DISTINCT CAST(id % 5 AS INTEGER) AS framework_id, DATE '2000-01-01' + CAST(id % 2000 AS INTEGER) AS as_of FROM organizations") + ")")
def _(s):
    found = versions.version_as_of(_asked(s), s.versions())
    return found.withColumns({c: F.col(c).cast("string") for c in ("as_of", "publication_date")})


@query("versioned_retrieval", """WITH q AS (SELECT evidence_id AS query_id, organization_id, CAST(evidence_id % 5 AS INTEGER) AS framework_id, DATE '2000-06-30' + CAST(366 * (evidence_id % 4) AS INTEGER) AS as_of, v FROM evidence_vectors),
    a AS (""" + _AS_OF.format("SELECT DISTINCT framework_id, as_of FROM q") + """)
    SELECT query_id, organization_id, version_id, requirement_id, similarity_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, requirement_id) AS rn
    FROM (SELECT q.query_id, q.organization_id, a.version_id, r.requirement_id, round(list_cosine_similarity(q.v, r.v), 6) AS similarity_score FROM q JOIN a USING (framework_id, as_of) JOIN requirement_vectors r ON r.requirement_id % 25 = a.version_id)) WHERE rn <= 3""")
def _(s):
    asked = s.evidence_vectors().select(F.col("evidence_id").alias("query_id"), "organization_id", (F.col("evidence_id") % 5).cast("int").alias("framework_id"), F.date_add(F.lit("2000-06-30").cast("date"), (366 * (F.col("evidence_id") % 4)).cast("int")).alias("as_of"), "v")
    required = s.requirement_vectors().select(F.col("requirement_id").cast("bigint").alias("requirement_id"), (F.col("requirement_id") % 25).cast("int").alias("version_id"), "v")
    return similarity.versioned_retrieval(asked, s.versions(), required, k=3)


_COVERAGE = """SELECT o.id AS organization_id, v.id AS version_id, coalesce(t.n, 0) AS total, coalesce(c.n, 0) AS covered, round(coalesce(c.n, 0) / nullif(t.n, 0), 6) AS ratio FROM organizations o CROSS JOIN versions v
    LEFT JOIN (SELECT version_id, count(*) AS n FROM requirements GROUP BY 1) t ON t.version_id = v.id
    LEFT JOIN (SELECT m.organization_id, r.version_id, count(DISTINCT m.requirement_id) AS n FROM mappings m JOIN requirements r ON m.requirement_id = r.id WHERE m.status = 'approved' GROUP BY 1, 2) c ON c.organization_id = o.id AND c.version_id = v.id"""


def coverage_of(s: Standin) -> DataFrame:
    return coverage.coverage(s.organizations(), s.versions(), s.requirements(), s.mappings())


@query("coverage", _COVERAGE)
def _(s):
    return coverage_of(s)


@query("coverage_rollup", f"""SELECT framework_id, version_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(covered) AS BIGINT) AS covered, CAST(grouping(framework_id, version_id) AS BIGINT) AS level,
    round(sum(covered) / nullif(sum(total), 0), 6) AS ratio FROM ({_COVERAGE}) c JOIN versions v ON c.version_id = v.id GROUP BY ROLLUP (framework_id, version_id)""")
def _(s):
    return coverage.coverage_rollup(coverage_of(s), s.versions())


@query("coverage_gaps", """SELECT o.id AS organization_id, r.version_id, r.id AS requirement_id FROM organizations o JOIN requirements r ON r.version_id = o.id % 25
    WHERE NOT EXISTS (SELECT 1 FROM mappings m WHERE m.organization_id = o.id AND m.requirement_id = r.id AND m.status = 'approved')""")
def _(s):
    scope = s.organizations().select(F.col("id").alias("organization_id"), (F.col("id") % 25).cast("int").alias("version_id"))
    return coverage.coverage_gaps(scope, s.requirements(), s.mappings())


@query("mapping_status_counts", """SELECT m.organization_id, r.version_id, count(*) FILTER (m.status = 'pending') AS pending, count(*) FILTER (m.status = 'approved') AS approved, count(*) FILTER (m.status = 'rejected') AS rejected,
    round(avg(similarity_score), 6) AS mean_similarity, max(similarity_score) AS max_similarity, count(DISTINCT evidence_id) AS evidence FROM mappings m JOIN requirements r ON m.requirement_id = r.id GROUP BY 1, 2""")
def _(s):
    return coverage.mapping_status_counts(s.mappings(), s.requirements())


@query("mapping_sketches", """SELECT m.organization_id, count(*) FILTER (m.status = 'pending') AS pending, count(*) FILTER (m.status = 'approved') AS approved, count(*) FILTER (m.status = 'rejected') AS rejected,
    max(similarity_score) AS max_similarity, count(DISTINCT evidence_id) AS evidence, true AS estimate_in_bound FROM mappings m JOIN requirements r ON m.requirement_id = r.id GROUP BY 1""")
def _(s):
    """Roll-up by organization of stored sketches, each estimate held against the exact count of distinct evidence."""
    root = scratch_path(s.spark)
    coverage.mapping_sketches(s.mappings(), s.requirements()).write.parquet(root)
    merged = coverage.merged_sketches(s.spark.read.parquet(root), "organization_id").withColumnRenamed("evidence", "estimate")
    exact = s.mappings().join(s.requirements().select(F.col("id").alias("requirement_id")), "requirement_id").groupBy("organization_id").agg(F.count_distinct("evidence_id").alias("evidence"))
    close = F.abs(F.col("estimate") - F.col("evidence")) <= 4 * coverage.SKETCH_ERROR * F.col("evidence") + 1
    return merged.join(exact, "organization_id").select("organization_id", "pending", "approved", "rejected", "max_similarity", "evidence", close.alias("estimate_in_bound"))


@query("best_evidence", """SELECT organization_id, requirement_id, evidence_id, similarity_score, status, rn FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, requirement_id ORDER BY similarity_score DESC NULLS LAST, evidence_id, status) AS rn
    FROM mappings WHERE requirement_id IS NOT NULL) WHERE rn <= 3""")
def _(s):
    return coverage.best_evidence(s.mappings(), 3)


_DIFF = """SELECT coalesce(a.o, b.o) AS old_version_id, coalesce(a.n, b.n) AS new_version_id, coalesce(a.code, b.code) AS code,
    CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.title IS NOT DISTINCT FROM b.title AND a.description IS NOT DISTINCT FROM b.description THEN 'unchanged' ELSE 'modified' END AS change, a.id AS old_id, b.id AS new_id
    FROM (SELECT o, n, r.* FROM p JOIN requirements r ON r.version_id = o) a FULL JOIN (SELECT o, n, r.* FROM p JOIN requirements r ON r.version_id = n) b ON a.o = b.o AND a.n = b.n AND a.code = b.code"""
_PAIRS = "p AS (SELECT id AS o, lead(id) OVER (PARTITION BY framework_id ORDER BY publication_date, version_slug, id) AS n FROM versions QUALIFY n IS NOT NULL)"


def _diff(s: Standin) -> DataFrame:
    return versions.version_diff(s.requirements(), versions.consecutive_pairs(s.versions()))


@query("version_diff", f"WITH {_PAIRS} {_DIFF}")
def _(s):
    return _diff(s)


@query("change_impact", f"""WITH {_PAIRS}, d AS ({_DIFF}) SELECT old_version_id, new_version_id, change, organization_id, count(DISTINCT requirement_id) AS requirements, count(*) AS mappings, count(DISTINCT evidence_id) AS evidence
    FROM d JOIN mappings m ON m.requirement_id = d.old_id WHERE change IN ('removed', 'modified') GROUP BY 1, 2, 3, 4""")
def _(s):
    return versions.change_impact(_diff(s), s.mappings())


@query("carry_forward", f"""WITH {_PAIRS}, d AS ({_DIFF}) SELECT old_version_id, new_version_id, organization_id, evidence_id, new_id AS requirement_id, similarity_score, CASE WHEN change = 'modified' THEN 'pending' ELSE status END AS status
    FROM d JOIN mappings m ON m.requirement_id = d.old_id WHERE change IN ('unchanged', 'modified')""")
def _(s):
    return versions.carry_forward(_diff(s), s.mappings())


@query("extract_obligations", r"""SELECT document_id, seq, sentence, regexp_extract(sentence, '(?i)license', 0) AS term FROM (SELECT id AS document_id, unnest(x) AS sentence, unnest(range(len(x))) AS seq
    FROM (SELECT id, regexp_split_to_array(extracted_text, '[.!?]\s+|\n') AS x FROM text_documents)) WHERE regexp_matches(sentence, '(?i)license')""")
def _(s):
    return text.extract_obligations(s.text_documents(), "(?i)license")


@query("extract_terms", r"""WITH t AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM benchmark)),
    s AS (SELECT id AS document_id, unnest(x) AS sentence, unnest(range(len(x))) AS seq FROM (SELECT id, regexp_split_to_array(extracted_text, '[.!?]\s+|\n') AS x FROM text_documents)),
    w AS (SELECT document_id, seq, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}_]+') AS ws FROM s))
    SELECT document_id, seq, arg_min(word, pos) AS term FROM w WHERE lower(word) IN (SELECT term FROM t) GROUP BY 1, 2""")
def _(s):
    """Sentences with a word of a long list: all words of six letters and more of the benchmark."""
    words = s.table("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return text.extract_obligations(s.text_documents(), sorted(r.w for r in words.collect())).select("document_id", "seq", "term")


@query("extract_requirement_codes", r"""SELECT document_id, seq, regexp_extract(line, '^([A-Za-z]+) \| (.*)$', 1) AS code, regexp_extract(line, '^([A-Za-z]+) \| (.*)$', 2) AS title FROM (SELECT id AS document_id, unnest(x) AS line, unnest(range(len(x))) AS seq
    FROM (SELECT id, string_split(extracted_text, chr(10)) AS x FROM text_documents)) WHERE regexp_matches(line, '^([A-Za-z]+) \| (.*)$')""")
def _(s):
    return text.extract_requirement_codes(s.text_documents(), r"^([A-Za-z]+) \| (.*)$")


# --- objects and extractors ------------------------------------------------------------------------------------

def _objects(s: Standin) -> str:
    """A folder with the documents as objects, below 256 folders by the hash of their names, so that many tasks list them."""
    root = f"{scratch_path(s.spark)}/bucket"
    folder = F.lpad(F.hex(F.pmod(F.xxhash64("file_path"), F.lit(256))), 2, "0")
    write_objects(s.text_documents().select(F.concat(folder, F.lit("/"), "file_path").alias("file_path"), F.col("extracted_text").cast("binary").alias("content")), root).write.format("noop").mode("overwrite").save()
    return root


def _without_folder(objects: DataFrame) -> DataFrame:
    return objects.withColumn("file_path", F.expr("substr(file_path, 4)"))


@query("read_objects", "SELECT file_path, CAST(strlen(extracted_text) AS BIGINT) AS length, md5(extracted_text) AS digest FROM text_documents WHERE extracted_text IS NOT NULL")
def _(s):
    return _without_folder(read_listed(s.spark, _objects(s))).select("file_path", "length", F.md5("content").alias("digest"))


_PARTS = "len(string_split(extracted_text, chr(10)))"


@query("extractor_registry", f"""SELECT id AS document_id, CASE id % 4 WHEN 3 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE id % 4 WHEN 0 THEN {_PARTS} WHEN 1 THEN 1 WHEN 2 THEN 1 END AS page_count,
    md5(CASE id % 4 WHEN 0 THEN array_to_string(list_filter(string_split(extracted_text, chr(10)), lambda x: x <> ''), chr(10)) WHEN 1 THEN extracted_text WHEN 2 THEN extracted_text END) AS digest,
    CASE id % 4 WHEN 3 THEN 'broken file' END AS error FROM text_documents""")
def _(s):
    """Kinds with extractors of one's own: pages are lines here, and one kind of file breaks its extractor."""

    def pages(content: bytes) -> tuple[list[str], int]:
        lines = content.decode().split("\n")
        if lines[0] == "broken":
            raise ValueError("broken file")
        return [x for x in lines if x], len(lines)

    docs = s.text_documents()
    ending = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".docx", ".txt", ".pdf")]), (F.col("id") % 4 + 1).cast("int"))
    docs = docs.select("id", F.concat(F.lit("d"), F.col("id").cast("string"), ending).alias("file_path"), F.when(F.col("id") % 4 == 3, F.concat(F.lit("broken\n"), "extracted_text")).otherwise(F.col("extracted_text")).cast("binary").alias("content"))
    own = {"pdf": pages, "docx": lambda content: (content.decode().split("\n"), 1)}
    done = extract.process_documents(docs.select(F.col("id").alias("document_id"), "file_path"), docs.select("file_path", "content"), own)
    return done.select("document_id", "status", "page_count", F.md5(F.col("extracted_text").cast("binary")).alias("digest"), "error")


# --- streams, run until their input is used up -----------------------------------------------------------------

def _log_stream(s: Standin) -> DataFrame:
    folder = f"{s.dir}/events.parquet"
    schema = s.table("events").schema
    path = s.spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(s.spark._jsc.hadoopConfiguration())
    source = folder if store.getFileStatus(path).isDirectory() else s.dir
    rows = s.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if source == folder else "events.parquet").parquet(source)
    return Standin.status_log(type("Streamed", (), {"table": staticmethod(lambda name: rows)})())


def _drained(df: DataFrame, mode: str, at_end: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """What a stream gives until its input is used up, in the shared folder: the last batch in mode complete, all of them in mode append.

    ``at_end`` gives rows that the stream has not told yet from its checkpoint, if there was any input.
    """
    spark, root, batches = df.sparkSession, scratch_path(df.sparkSession), []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{root}/last" if mode == "complete" else f"{root}/all/batch={batch_id}")

    keep(spark.createDataFrame([], df.schema), -1)  # so that a stream without input gives an empty table
    df.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{root}/last" if mode == "complete" else f"{root}/all").select(*df.columns)
    return out.unionByName(at_end(spark, f"{root}/checkpoint")) if at_end and max(batches) >= 0 else out


@query("stream_latest_status", _LATEST)
def _(s):
    return _drained(jobs.stream_latest_status(_log_stream(s)), "complete")


@query("stream_landing", f"""SELECT file_path, {EXT.format('file_path')} AS extension, CAST(strlen(extracted_text) AS BIGINT) AS length,
    CASE WHEN {_KIND} = 'txt' THEN CAST({_words('extracted_text')} AS BIGINT) END AS word_count FROM text_documents WHERE extracted_text IS NOT NULL""")
def _(s):
    return _drained(_without_folder(jobs.stream_landing(s.spark, _objects(s))), "append")


@query("stream_stuck_documents", """SELECT document_id, ts AS since FROM (SELECT *, lead(ts) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS later, max(ts) OVER () AS last FROM status_log)
    WHERE status = 'PROCESSING' AND CASE WHEN later IS NOT NULL THEN (epoch_us(later) - epoch_us(ts)) // 1000 > 1800000 ELSE epoch_us(ts) // 1000 + 1800001 < epoch_us(last) // 1000 - 600000 END""")
def _(s):
    kind = s.table("events").schema["ts"].dataType
    log = _log_stream(s).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(jobs.stream_stuck_documents(log), "append", jobs.stuck_at_the_end).withColumn("since", F.col("since").cast(kind))


def _pending(s: Standin, root: str) -> Snapshots:
    artifacts = Snapshots(s.spark, f"{root}/artifacts", 16, text_digits=1)
    artifacts.write(s.text_documents().select("id", F.lit("PENDING").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("extracted_text", "string"), ("page_count", "int"), ("word_count", "int"))), now().alias("updated_at")), 0)
    return artifacts


_OUTCOME = f"SELECT document_id AS id, status, page_count, word_count, digest FROM ({_PROCESSED})"


def _outcome(artifacts: Snapshots) -> DataFrame:
    return artifacts.read().select("id", "status", "page_count", "word_count", F.md5(F.col("extracted_text").cast("binary")).alias("digest"))


@query("stream_process_documents", _OUTCOME)
def _(s):
    tasks, objects = _tasks_and_objects(s)
    root = scratch_path(s.spark)
    tasks.write.parquet(f"{root}/queue")
    artifacts = _pending(s, root)
    queue = s.spark.readStream.schema(tasks.schema).parquet(f"{root}/queue")
    jobs.stream_process_documents(queue, lambda: objects, artifacts, f"{root}/checkpoint").awaitTermination()
    return _outcome(artifacts)


@query("stream_repeated_tasks", _OUTCOME)
def _(s):
    """A queue that delivers every task again, in a batch of its own, when its object is gone: the repetition changes nothing."""
    tasks, objects = _tasks_and_objects(s)
    root, calls = scratch_path(s.spark), []
    for minute in (0, 1):
        tasks.withColumn("queued_at", now() + F.make_dt_interval(mins=F.lit(minute))).coalesce(1).write.mode("append").parquet(f"{root}/queue")
    artifacts = _pending(s, root)
    queue = s.spark.readStream.schema(s.spark.read.parquet(f"{root}/queue").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/queue")
    jobs.stream_process_documents(queue, lambda: objects if calls.append(1) or len(calls) == 1 else objects.limit(0), artifacts, f"{root}/checkpoint", queued_at="queued_at").awaitTermination()
    return _outcome(artifacts)
