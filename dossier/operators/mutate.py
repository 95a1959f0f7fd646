"""Inserts, updates, deletes and status work on entity tables. Each returns new tables; nothing is changed in place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import exprs
from dossier.schemas import HARD_LIMIT_SECONDS, RULES
from dossier.sources.tables import scratch_path


#: Folders of bit maps, by a hash of the file that they are about.
SHELVES = 1024


def land_objects(uploads: DataFrame, key: str = "file_path", at: str = "uploaded_at", upload_id: str = "upload_id") -> DataFrame:
    """The last upload of each key, whoever sent it: one row for each key that is not null.

    Only keys, times and ids are ranked. Of rows from Parquet files the last ones are known by file and place; bit maps
    of these places are written to the shared folder, and contents are picked where they lie: they are in no shuffle,
    join or Python worker. Other rows have no place of their own: they are joined with what was ranked.
    """
    rows = uploads.where(F.col(key).isNotNull())
    try:
        placed = rows.select(*uploads.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not from Parquet files
        last = rows.groupBy(key).agg(F.max(F.struct(at, upload_id)).alias("last"))
        last = last.select(F.col(key).alias("__key"), F.col(f"last.{at}").alias("__at"), F.col(f"last.{upload_id}").alias("__id"))
        same = (rows[key] == F.col("__key")) & rows[at].eqNullSafe(F.col("__at")) & rows[upload_id].eqNullSafe(F.col("__id"))
        return rows.join(last, same, "left_semi").dropDuplicates([key])
    last = placed.groupBy(key).agg(F.max(F.struct(at, upload_id, "__file", "__row")).alias("last")).select("last.__file", (F.col("last.__row") + 1).alias("place"))
    root = scratch_path(uploads.sparkSession)
    maps = last.groupBy("__file", F.bitmap_bucket_number("place").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    maps.withColumn("shelf", _shelf()).repartition("shelf").write.partitionBy("shelf").parquet(root)
    return placed.where(_stands(root)("__file", "__row", _shelf())).select(*uploads.columns)


def _shelf() -> Column:
    return F.pmod(F.xxhash64("__file"), F.lit(SHELVES)).cast("int")


def _stands(root: str):
    """Whether the bit of a row is set in the maps below ``root``. A task keeps the maps of one file, a bit for each of its rows."""
    held: dict[str, dict[int, np.ndarray]] = {}

    def maps_of(file: str, shelf: int) -> dict[int, np.ndarray]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        if file not in held:
            held.clear()
            store, base = fs.FileSystem.from_uri(f"{root}/shelf={shelf}")
            held[file] = {}
            if store.get_file_info(base).type == fs.FileType.Directory:
                found = ds.dataset(base, filesystem=store, format="parquet").to_table(["number", "bits"], filter=ds.field("__file") == file)
                held[file] = {n: np.frombuffer(b, dtype=np.uint8) for n, b in zip(*(found.column(c).to_pylist() for c in ("number", "bits")), strict=True)}
        return held[file]

    @F.pandas_udf("boolean")
    def stands(files: pd.Series, rows: pd.Series, shelves: pd.Series) -> pd.Series:
        out = np.zeros(len(files), dtype=bool)
        places = rows.to_numpy()
        for file, at in files.groupby(files).indices.items():
            maps, number = maps_of(file, int(shelves.iloc[at[0]])), 1 + places[at] // 32_768
            for n in np.unique(number):
                if n in maps:
                    mine = at[number == n]
                    bit = places[mine] % 32_768
                    out[mine] = (maps[n][bit // 8] >> (bit % 8)) & 1
        return pd.Series(out)

    return stands


def ingest_uploads(manifest: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rejected, artifacts, tasks) of a manifest (document_id, organization_id, filename, content_type, title).

    Ids are the caller's: an id made here would differ each time the plan is run. Rejected rows carry the
    reason. Artifacts are PENDING and have no size, mime type or text yet.
    """
    now = F.current_timestamp() if now is None else now
    name, mime = F.coalesce("filename", F.lit("")), F.col("content_type")
    ok = exprs.upload_allowed(name, mime)
    rejected = manifest.where(~ok).select("document_id", "organization_id", "filename", exprs.reject_reason(name, mime).alias("reason"))
    taken = manifest.where(ok)
    nothing = {"file_size": "int", "mime_type": "string", "extracted_text": "string", "page_count": "int", "word_count": "int"}
    artifacts = taken.select(F.col("document_id").alias("id"), "organization_id", exprs.display_name(F.col("title"), name).alias("name"), name.alias("file_path"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit("PENDING").alias("status"), now.alias("created_at"), now.alias("updated_at"))
    tasks = taken.select("document_id", name.alias("file_path"), F.lit("queued").alias("status"))
    return rejected, artifacts, tasks


UPDATE_FIELDS = ("extracted_text", "page_count", "word_count")


def fold_updates(updates: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row for each id: its last status, and of every other field the last value that is not null."""
    place = F.struct(*order)
    return updates.where("id IS NOT NULL").groupBy("id").agg(F.max_by("status", place).alias("status"), *(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in UPDATE_FIELDS))


def apply_status_updates(artifacts: DataFrame, updates: DataFrame, now: Column, order: tuple[str, ...] = ("ts",)) -> tuple[DataFrame, DataFrame]:
    """(artifacts, report) after a batch of updates (id, status, extracted_text?, page_count?, word_count?).

    A status is always set, the other fields only where not null (empty texts and zeros do count). ``updated_at``
    moves if anything changed. Ids that are no artifact's are never inserted; the report has every update's id
    and whether it was applied (a null id: false).
    """
    fields = ("status", *UPDATE_FIELDS)
    new = fold_updates(updates, order).select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = artifacts.join(new, artifacts["id"] == new["__id"], "left")
    values = {c: F.coalesce(f"__{c}", c) for c in fields}
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~values[c].eqNullSafe(F.col(c))
    out = joined.select(*(F.when(changed, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else values[c].alias(c) if c in values else F.col(c) for c in artifacts.columns))
    known = artifacts.select(F.col("id").alias("__known"))
    ids = updates.select("id").distinct()
    report = ids.join(known, ids["id"] == known["__known"], "left").select("id", F.col("__known").isNotNull().alias("applied"))
    return out, report


def update_rows(df: DataFrame, patch: DataFrame, now: Column, id_col: str = "id") -> DataFrame:
    """Patched rows: the patch's fields overwrite, with null too; fields that the table lacks are ignored.

    ``updated_at`` moves only where a value really changed. The patch has one row for each id.
    """
    fields = [c for c in patch.columns if c in df.columns and c not in (id_col, "updated_at")]
    new = patch.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = df.join(new, df[id_col] == new["__id"], "left")
    hit, changed = F.col("__id").isNotNull(), F.lit(False)
    for c in fields:
        changed = changed | ~F.col(f"__{c}").eqNullSafe(F.col(c))

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(hit & changed, now).otherwise(F.col(c)).alias(c)
        return F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)

    return joined.select(*(value(c) for c in df.columns))


def create_rows(existing: DataFrame, new: DataFrame, table: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(created, rejected): new rows with their defaults, and those that break a unique key of the table.

    Nulls in columns with a default take it. Of new rows with one key the first by id stands; rows whose key
    exists already are rejected. Nulls in a key break nothing.
    """
    rules, columns = RULES[table], existing.columns
    defaults = {**rules.defaults, "created_at": now, "updated_at": now}
    types = {f.name: f.dataType for f in existing.schema}
    rows = new.select(*(F.col(c).cast(types[c]).alias(c) if c in new.columns else F.lit(None).cast(types[c]).alias(c) for c in columns))
    rows = rows.withColumns({c: F.coalesce(c, v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items() if c in columns})
    broken = F.lit(False)
    for k, key in enumerate(rules.unique):
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(c).isNotNull()
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in ("created_at", "id") if c in columns]))
        rows = rows.withColumn(f"__rn{k}", F.when(whole, place).otherwise(1))
        taken = existing.select(*key).distinct().withColumn(f"__old{k}", F.lit(True))
        rows = rows.join(taken, list(key), "left")
        broken = broken | (F.col(f"__rn{k}") > 1) | F.coalesce(f"__old{k}", F.lit(False))
    rows = rows.withColumn("__broken", broken)
    return rows.where("NOT __broken").select(*columns), rows.where("__broken").select(*columns)


#: Children of each table: (child table, its column).
CHILDREN = {
    "organizations": (("evidence_artifacts", "organization_id"), ("compliance_mappings", "organization_id")),
    "evidence_artifacts": (("compliance_mappings", "evidence_id"),),
    "regulatory_frameworks": (("regulatory_versions", "framework_id"),),
    "regulatory_versions": (("regulatory_requirements", "version_id"),),
    "regulatory_requirements": (("compliance_mappings", "requirement_id"),),
}


def delete_cascade(tables: dict[str, DataFrame], table: str, ids: DataFrame, mode: str = "orm") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report) after rows of ``table`` with these ids and all that hangs on them are deleted.

    ``mode="db"`` differs in one rule: a mapping whose requirement is deleted stays, with a null requirement_id.
    The report has each id and whether it was there.
    """
    found = ids.select("id").distinct().join(tables[table].select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left")
    report = found.select("id", F.col("__id").isNotNull().alias("deleted"))
    out = dict(tables)
    todo = [(table, found.where("__id IS NOT NULL").select("id"))]
    while todo:
        name, gone = todo.pop(0)
        for child, column in CHILDREN.get(name, ()):
            rows = out[child]
            if name == "regulatory_requirements" and mode == "db":
                mark = gone.select(F.col("id").alias("__gone"))
                rows = rows.join(mark, rows[column] == mark["__gone"], "left")
                out[child] = rows.select(*(F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in tables[child].columns))
            else:
                todo.append((child, rows.join(gone.select(F.col("id").alias(column)), column, "left_semi").select("id")))
        out[name] = out[name].join(gone, "id", "left_anti")
    return out, report


def delete_requirement_set_null(tables: dict[str, DataFrame], ids: DataFrame, mode: str = "orm") -> tuple[dict[str, DataFrame], DataFrame]:
    return delete_cascade(tables, "regulatory_requirements", ids, mode)


def document_status(ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each asked id: document_id, found, message, status, text_preview, page_count, word_count."""
    asked = ids.select(F.col("id").alias("document_id"))
    rows = asked.join(artifacts.select("id", "status", "extracted_text", "page_count", "word_count"), F.col("document_id") == F.col("id"), "left")
    found = F.col("id").isNotNull()
    message = F.when(~found, F.concat(F.lit("Document with ID '"), F.col("document_id").cast("string"), F.lit("' not found.")))
    return rows.select("document_id", found.alias("found"), message.alias("message"), F.when(found, exprs.status_view(F.col("status"))).alias("status"), exprs.text_preview(F.col("status"), F.col("extracted_text")).alias("text_preview"), "page_count", "word_count")


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each document of a log (document_id, ts, event_id, status)."""
    last = log.groupBy("document_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last"))
    return last.select("document_id", "last.status", F.col("last.ts").alias("since"))


def stuck_documents(artifacts: DataFrame, now: Column, limit_seconds: int = HARD_LIMIT_SECONDS) -> DataFrame:
    """Documents that have been PROCESSING for longer than the limit."""
    return artifacts.where((F.col("status") == "PROCESSING") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(limit_seconds))))


def object_reconciliation(artifacts: DataFrame, objects: DataFrame, key: str = "file_path") -> DataFrame:
    """problem, file_path, n: artifacts without an object, objects without an artifact, and paths of several tenants."""
    rows = artifacts.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("organization_id").alias("tenants"))
    blobs = objects.groupBy(key).agg(F.count("*").alias("n"))
    name = lambda df, problem, n: df.select(F.lit(problem).alias("problem"), key, F.col(n).cast("bigint").alias("n"))
    parts = (name(rows.join(blobs, key, "left_anti"), "missing_object", "n"), name(blobs.join(rows, key, "left_anti"), "orphan_object", "n"), name(rows.where("tenants > 1"), "shared_path", "tenants"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
