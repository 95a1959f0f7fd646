"""Keyed lookups and paging. A table of keys comes in, the rows found come out.

Rows have a fixed order: ``created_at`` (where the table has it), then ``id``. A null key matches nothing.
Keys are joined, not broadcast by hint: adaptive execution broadcasts a side that turns out small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.schemas import PAGE_LIMIT, RESPONSE_COLUMNS


def row_order(df: DataFrame) -> list[str]:
    return [c for c in ("created_at", "id") if c in df.columns]


def get_by_id(keys: DataFrame, df: DataFrame, id_col: str = "id") -> DataFrame:
    """Every key with its row; nulls where there is none. Keys may repeat."""
    return keys.select(id_col).join(df, id_col, "left")


def list_page(df: DataFrame, skip: int = 0, limit: int = PAGE_LIMIT, order: list[str] | None = None) -> DataFrame:
    return df.orderBy(*(order or row_order(df))).offset(skip).limit(limit)


def list_after(df: DataFrame, created_at, last_id, limit: int = PAGE_LIMIT) -> DataFrame:
    """The page behind the row (created_at, last_id): work for deep pages does not grow with their depth."""
    after = (F.col("created_at") > created_at) | ((F.col("created_at") == created_at) & (F.col("id") > last_id))
    return df.where(after).orderBy("created_at", "id").limit(limit)


def page_per_group(df: DataFrame, group: str, skip: int = 0, limit: int = PAGE_LIMIT, order: list | None = None) -> DataFrame:
    """A page of every group at once, with ``rn``, its place from 1. Rows beyond the page go before the shuffle."""
    w = Window.partitionBy(group).orderBy(*(order or row_order(df)))
    return df.withColumn("rn", F.row_number().over(w)).where((F.col("rn") > skip) & (F.col("rn") <= skip + limit))


def list_by_organization(df: DataFrame, organization_id, skip: int = 0, limit: int = PAGE_LIMIT) -> DataFrame:
    """One tenant's page."""
    return list_page(df.where(F.col("organization_id") == organization_id), skip, limit)


def first_per_key(keys: DataFrame, df: DataFrame, key_cols: list[str], order: list[str] | None = None) -> DataFrame:
    """The first row of each distinct key that has one."""
    found = df.join(keys.select(*key_cols).distinct(), key_cols, "left_semi")
    w = Window.partitionBy(*key_cols).orderBy(*(order or row_order(df)))
    return found.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def rows_by_key(keys: DataFrame, df: DataFrame, key_cols: list[str]) -> DataFrame:
    """All rows of the keys, each once."""
    return df.join(keys.select(*key_cols), key_cols, "left_semi")


def tenant_scope(df: DataFrame, tenants: DataFrame, tenant_col: str = "organization_id") -> DataFrame:
    return rows_by_key(tenants, df, [tenant_col])


def document_response(evidence: DataFrame) -> DataFrame:
    """The read model: twelve columns in fixed order."""
    return evidence.select(*RESPONSE_COLUMNS)


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds absent columns as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
