"""The six entity tables: types, keys, limits and status vocabularies. Audits and defaults are driven by these."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _TS, _I, _D = T.StringType(), T.TimestampType(), T.IntegerType(), T.DoubleType()

# Table layouts, length limits, status words, accepted file types.
EVIDENCE_STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
MAPPING_STATUSES = ("pending", "approved", "rejected")
ALLOWED_EXTENSIONS = (".docx", ".pdf", ".txt")
ALLOWED_MIME_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain")
PREVIEW_CHARS = 300
PAGE_LIMIT = 100
HARD_LIMIT_SECONDS = 1800
SOFT_LIMIT_SECONDS = 1500


def _schema(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


_STAMPS = (("created_at", _TS, False), ("updated_at", _TS, False))

SCHEMAS: dict[str, T.StructType] = {
    "organizations": _schema(("id", _S, False), ("name", _S, False), *_STAMPS),
    "regulatory_frameworks": _schema(("id", _S, False), ("name", _S, False), ("description", _S, True), *_STAMPS),
    "regulatory_versions": _schema(("id", _S, False), ("framework_id", _S, False), ("version_slug", _S, False), ("description", _S, True), ("publication_date", T.DateType(), True), ("is_active", T.BooleanType(), False), *_STAMPS),
    "regulatory_requirements": _schema(("id", _S, False), ("version_id", _S, False), ("code", _S, False), ("title", _S, False), ("description", _S, True), *_STAMPS),
    "evidence_artifacts": _schema(("id", _S, False), ("organization_id", _S, False), ("name", _S, False), ("file_path", _S, False), ("file_size", _I, True), ("mime_type", _S, True), ("extracted_text", _S, True), ("page_count", _I, True), ("word_count", _I, True), ("status", _S, False), *_STAMPS),
    "compliance_mappings": _schema(("id", _S, False), ("organization_id", _S, False), ("evidence_id", _S, False), ("requirement_id", _S, True), ("similarity_score", _D, True), ("status", _S, False), *_STAMPS),
}


@dataclass(frozen=True)
class Rules:
    """What a table's database would enforce."""

    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[tuple[str, str], ...] = ()  # (column, parent table), to the parent's id
    lengths: dict[str, int] = field(default_factory=dict)
    statuses: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)


RULES: dict[str, Rules] = {
    "organizations": Rules((("id",), ("name",)), (), {"name": 255}),
    "regulatory_frameworks": Rules((("id",), ("name",)), (), {"name": 255}),
    "regulatory_versions": Rules((("id",), ("framework_id", "version_slug")), (("framework_id", "regulatory_frameworks"),), {"version_slug": 50}, (), {"is_active": True}),
    "regulatory_requirements": Rules((("id",), ("version_id", "code")), (("version_id", "regulatory_versions"),), {"code": 100, "title": 255}),
    "evidence_artifacts": Rules((("id",),), (("organization_id", "organizations"),), {"name": 255, "file_path": 512, "mime_type": 100, "status": 50}, EVIDENCE_STATUSES, {"status": "PENDING"}),
    "compliance_mappings": Rules((("id",),), (("organization_id", "organizations"), ("evidence_id", "evidence_artifacts"), ("requirement_id", "regulatory_requirements")), {"status": 50}, MAPPING_STATUSES, {"status": "pending"}),
}

#: Fields that the read model of an uploaded document shows.
RESPONSE_COLUMNS = ("id", "organization_id", "name", "file_path", "file_size", "mime_type", "extracted_text", "page_count", "word_count", "status", "created_at", "updated_at")
