"""The entity tables as views over the generated star schema, the same ones that ``STANDIN_SQL`` defines in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STANDIN_SQL = {
    "organizations": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "frameworks": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "versions": """SELECT n_nationkey AS id, n_regionkey AS framework_id, 'v' || CAST(n_nationkey // 5 + 1 AS VARCHAR) AS version_slug,
        make_date(CAST(2000 + n_nationkey // 5 AS INT), 1, 1) AS publication_date, n_nationkey <> 22 AS is_active FROM nation""",
    "requirements": """SELECT p_partkey AS id, CAST(substr(p_brand, 7) AS INT) - 1 AS version_id,
        'CC' || CAST(p_size AS VARCHAR) || '.' || CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS VARCHAR) AS code,
        p_type AS title, CASE WHEN p_size % 2 = 1 THEN split_part(p_name, ' ', 1) END AS description FROM part""",
    "evidence": """SELECT o_orderkey AS id, o_custkey AS organization_id, 'f' || CAST(o_orderkey AS VARCHAR) ||
        CASE o_orderkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.txt' WHEN 3 THEN '.text' WHEN 4 THEN '.md' ELSE '' END AS file_path,
        CASE WHEN o_orderkey % 6 IN (3, 4) AND o_orderkey % 4 < 2 THEN 'text/plain' WHEN o_orderkey % 6 = 0 THEN 'application/pdf' END AS mime_type,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PROCESSING' ELSE 'FAILED' END END AS status,
        o_orderdate AS created_at FROM orders""",
    "mappings": """SELECT l_orderkey AS evidence_id, o_custkey AS organization_id, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS requirement_id,
        CASE WHEN l_tax <> 0 THEN round(l_discount * 10, 6) END AS similarity_score,
        CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status,
        CASE WHEN l_quantity = 50 THEN l_suppkey ELSE o_custkey END AS claimed_organization_id, l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "text_documents": """SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS organization_id,
        'doc' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.text' ELSE '.md' END AS file_path, text AS extracted_text,
        CASE doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'COMPLETED' END AS status FROM documents""",
    "status_log": """SELECT event_id, user_id AS document_id, ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING'
        WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM events""",
    "document_pages": "SELECT conv_id AS document_id, turn AS page_no, CASE WHEN turn = 2 THEN '' ELSE text END AS page_text FROM conversations",
    "evidence_vectors": "SELECT vec_id AS evidence_id, label AS organization_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0",
    "requirement_vectors": "SELECT vec_id AS requirement_id, label % 5 AS framework_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1",
}


def with_views(sql: str) -> str:
    """The statement with the views that it names, as common table expressions."""
    import re

    names, todo = [], [sql]
    while todo:
        text = todo.pop()
        for n in STANDIN_SQL:
            if n not in names and re.search(rf"\b{n}\b", text):
                names.append(n)
    head = ",\n".join(f"{n} AS ({STANDIN_SQL[n]})" for n in STANDIN_SQL if n in names)
    sql = sql.strip()
    if not head:
        return sql
    return f"WITH {head},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head}\n{sql}"


#: What a task takes of a shuffle at most, compressed, and how many parts a shuffle is dealt to for each such size of a table.
TASK_BYTES = 8 << 20

#: Bytes of a table's columns at rest up to which it is broadcast without having been counted.
SMALL_FILE = 512 << 10


def deal_finely(spark: SparkSession, *tables: str) -> None:
    """Lets memory of a task stay as it is when tables grow: many parts of a shuffle, joined up to ``TASK_BYTES`` only.

    By default adaptive execution joins parts up to 64 MB, which as sorted rows are over a gigabyte, and deals 200 parts
    however large a table is. Broadcasts are chosen by the size of files, and rows made of dense columns are up to
    a hundred times larger in memory: a side of over ``SMALL_FILE`` bytes is shuffled first, and broadcast only if its rows
    turn out to be small. What the session sets itself stays.
    """
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", SMALL_FILE)
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", 10 << 20)
    target, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(target, None) is None:
        spark.conf.set(target, TASK_BYTES)
    if spark.conf.get(parts, None) is None or getattr(spark, "_dealt_by_size", False):
        jvm, hadoop, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table)
            store = path.getFileSystem(hadoop)
            size = max(size, store.getContentSummary(path).getLength() if store.exists(path) else 0)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(parts, max(least, 4 * size // TASK_BYTES))
        spark._dealt_by_size = True


class Standin:
    """The same views as DataFrames of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        deal_finely(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "events", "part", "customer")))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def organizations(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    def frameworks(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    def versions(self) -> DataFrame:
        era = F.expr("n_nationkey div 5")
        return self.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("framework_id"), F.concat(F.lit("v"), (era + 1).cast("string")).alias("version_slug"), F.make_date((era + 2000).cast("int"), F.lit(1), F.lit(1)).alias("publication_date"), (F.col("n_nationkey") != 22).alias("is_active"))

    def requirements(self) -> DataFrame:
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
        return self.table("part").select(F.col("p_partkey").alias("id"), (F.expr("substr(p_brand, 7)").cast("int") - 1).alias("version_id"), F.concat(F.lit("CC"), F.col("p_size").cast("string"), F.lit("."), place.cast("string")).alias("code"), F.col("p_type").alias("title"), F.when(F.col("p_size") % 2 == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("description"))

    def evidence(self) -> DataFrame:
        k = F.col("o_orderkey")
        ending = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".DOCX", ".txt", ".text", ".md", "")]), (k % 6 + 1).cast("int"))
        mime = F.when((k % 6).isin(3, 4) & (k % 4 < 2), "text/plain").when(k % 6 == 0, "application/pdf")
        status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise(F.when(k % 2 == 0, "PROCESSING").otherwise("FAILED"))
        return self.table("orders").select(k.alias("id"), F.col("o_custkey").alias("organization_id"), F.concat(F.lit("f"), k.cast("string"), ending).alias("file_path"), mime.alias("mime_type"), status.alias("status"), F.col("o_orderdate").alias("created_at"))

    def mappings(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey").hint("merge")  # grows with the facts, so it is never broadcast
        both = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "pending").otherwise("rejected")
        return both.select(
            F.col("l_orderkey").alias("evidence_id"), F.col("o_custkey").alias("organization_id"), F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("requirement_id"),
            F.when(F.col("l_tax") != 0, F.round(F.col("l_discount") * 10, 6)).alias("similarity_score"), status.alias("status"),
            F.when(F.col("l_quantity") == 50, F.col("l_suppkey")).otherwise(F.col("o_custkey")).alias("claimed_organization_id"), F.col("l_shipdate").alias("created_at"),
        )

    def text_documents(self) -> DataFrame:
        d = F.col("doc_id")
        ending = F.when(d % 3 == 0, ".txt").when(d % 3 == 1, ".text").otherwise(".md")
        status = F.when(d % 4 == 0, "completed").when(d % 4 == 1, "FAILED").when(d % 4 == 2, "COMPLETED")
        return self.table("documents").select(d.alias("id"), F.expr("substr(source, 4)").cast("int").alias("organization_id"), F.concat(F.lit("doc"), d.cast("string"), ending).alias("file_path"), F.col("text").alias("extracted_text"), status.alias("status"))

    def status_log(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "signup", "PENDING").when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").otherwise("PROCESSING")
        return self.table("events").select("event_id", F.col("user_id").alias("document_id"), "ts", status.alias("status"))

    def document_pages(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"), F.when(F.col("turn") == 2, "").otherwise(F.col("text")).alias("page_text"))

    def evidence_vectors(self) -> DataFrame:
        return self.table("embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("evidence_id"), F.col("label").alias("organization_id"), F.col("embedding").cast("array<double>").alias("v"))

    def requirement_vectors(self) -> DataFrame:
        return self.table("embeddings").where("vec_id % 2 = 1").select(F.col("vec_id").alias("requirement_id"), (F.col("label") % 5).alias("framework_id"), F.col("embedding").cast("array<double>").alias("v"))
