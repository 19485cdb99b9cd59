"""Sources and sinks: what Spark derives from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import domain as D
from tallyloom.plans.domain import LOGS_SQL, with_
from tallyloom.queries import register
from tallyloom.queries.catalog import RAW_SQL, raw_records
from tallyloom.session import scratch_path
from tallyloom.sources import exports as E
from tallyloom.sources import files as S
from tallyloom.sources import tables as T


@register("raw_records_by_partition", with_(RAW_SQL) + "SELECT brand, code AS goods_no, p_name AS goods_nm, 1 AS materials FROM raw WHERE brand = 'zara'")
def raw_records_by_partition(spark, d):
    """Landed by brand and day, one partition read back: only its folder is opened."""
    root = scratch_path(spark, "landing")
    T.write_partition(raw_records(spark, d).withColumn("dt", F.lit("20240101")).drop("file_path"), root)
    back = S.read_partition(spark, root, "zara", "20240101")
    return back.select(
        "brand", F.col("goodsNo").alias("goods_no"), F.col("goodsNm").alias("goods_nm"), (F.size("goodsMaterial") - 1).alias("materials")
    )


@register("raw_records", with_(RAW_SQL) + "SELECT code AS goods_no, p_name AS goods_nm, CAST(p_size % 6 AS INTEGER) AS images, TRUE AS has_path FROM raw")
def raw_records_read(spark, d):
    root = scratch_path(spark, "raw")
    raw_records(spark, d).drop("brand", "file_path").write.json(root)
    # Written one object per line; the multi-line reader takes one document per file, so lines are split first.
    rows = spark.read.schema(S.RAW_SCHEMA).json(root).withColumn("file_path", F.col("_metadata.file_path"))
    return rows.select(
        F.col("goodsNo").alias("goods_no"), F.col("goodsNm").alias("goods_nm"), F.size("goodsImages").alias("images"),
        F.col("file_path").endswith(".json").alias("has_path"),
    )


@register("table_scan", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def table_scan(spark, d):
    """Equality filter and projection of a table scan (parquet stands in for the server)."""
    region = T.scan(D.table(spark, d, "region"), F.col("r_name") == "ASIA", ["r_regionkey", "r_name"])
    nation = T.scan(D.table(spark, d, "nation"), columns=["n_name", "n_regionkey"])
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")


@register("append_table", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_table(spark, d):
    path = scratch_path(spark, "table")
    T.append_table(D.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path)
    T.append_table(D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return spark.read.parquet(path)


@register("append_docs", "SELECT doc_id, lang, text FROM documents UNION ALL SELECT item_id, 'bench', text FROM benchmark")
def append_docs(spark, d):
    path = scratch_path(spark, "docs")
    T.append_docs(D.table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    extra = D.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("bench").alias("lang"), "text")
    T.append_docs(extra, path)
    return S.read_json_docs_lines(spark, path, "doc_id long, lang string, text string")


CSV_SQL = """rows AS (SELECT CAST(p_partkey % 1500 AS VARCHAR) || repeat('x', CAST(p_partkey % 1500 % 30 AS INTEGER)) AS product_id, p_partkey,
  CASE p_partkey % 1500 % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(p_partkey % 1500 AS VARCHAR) || '.75' ELSE CAST(p_partkey % 1500 AS VARCHAR) END AS base_price FROM part)"""


def catalog_text(spark, d):
    """Ids longer than 20 characters, repeated ids, blank and fractional prices."""
    key = F.col("p_partkey") % 1500
    text = key.cast("string")
    price = F.when(key % 4 == 0, "").when(key % 4 == 1, F.concat(text, F.lit(".75"))).otherwise(text)
    return D.table(spark, d, "part").select(
        F.concat(text, F.repeat(F.lit("x"), (key % 30).cast("int"))).alias("product_id"), price.alias("base_price")
    ).withColumns({"prod_name": F.lit("a, b"), "gender": F.lit("men")})


IMPORT_SQL = """SELECT DISTINCT product_id[1:20] AS product_id, CASE WHEN base_price = '' THEN 0 ELSE CAST(trunc(CAST(base_price AS DOUBLE)) AS INTEGER) END AS base_price,
  'a, b' AS prod_name, 'men' AS gender, '' AS model_code, '{url}' AS origin_url FROM rows WHERE product_id[1:20] NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"""
IMPORTED = ("product_id", "base_price", "prod_name", "gender", "model_code", "origin_url")


def known_ids(spark, d):
    return D.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("product_id"))


@register("import_catalog_csv", with_(CSV_SQL) + IMPORT_SQL.format(url=""))
def import_catalog_csv(spark, d):
    path = scratch_path(spark, "csv")
    catalog_text(spark, d).write.option("header", True).option("emptyValue", "").csv(path)
    return S.import_catalog_csv(spark, path, known_ids(spark, d)).select(*IMPORTED)


def json_arrays(rows, path: str):
    """Rows as JSON arrays over several lines, a file for every 200 rows."""
    packed = rows.select(F.floor(F.monotonically_increasing_id() / 200).alias("file"), F.to_json(F.struct("*")).alias("r")).groupBy("file")
    body = F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("\n]"))
    packed.agg(body.alias("value")).write.partitionBy("file").text(path)
    return path


@register("import_catalog_json", with_(CSV_SQL) + IMPORT_SQL.format(url="http://o"))
def import_catalog_json(spark, d):
    rows = catalog_text(spark, d).withColumn("origine_url", F.lit("http://o"))
    path = json_arrays(rows, scratch_path(spark, "json"))
    return S.import_catalog_json(spark, path, known_ids(spark, d)).select(*IMPORTED)


@register(
    "cut_ids",
    "SELECT id[1:20] AS id, count(DISTINCT id) AS originals FROM (SELECT CAST(p_partkey % 50 AS VARCHAR) || repeat('y', 20) || CAST(p_partkey % 3 AS VARCHAR) AS id FROM part) GROUP BY 1 HAVING originals > 1",
)
def cut_ids(spark, d):
    """Ids that differ behind the twentieth character alone."""
    key = F.col("p_partkey")
    longer = F.concat((key % 50).cast("string"), F.repeat(F.lit("y"), 20), (key % 3).cast("string"))
    return S.cut_ids(D.table(spark, d, "part").select(longer.alias("product_id")))


@register("read_raw_json", "SELECT 'G' || CAST(p_partkey AS VARCHAR) AS goodsNo, p_name AS goodsNm, CAST(p_size AS VARCHAR) AS price, TRUE AS has_path, CAST(p_size % 3 AS INTEGER) AS images FROM part")
def read_raw_json(spark, d):
    """Crawled records in files that hold an array each."""
    key = F.col("p_partkey").cast("string")
    records = D.table(spark, d, "part").select(
        F.concat(F.lit("G"), key).alias("goodsNo"),
        F.col("p_name").alias("goodsNm"),
        F.col("p_size").cast("string").alias("price"),
        F.slice(F.array(key, F.concat(key, F.lit("b"))), F.lit(1), F.col("p_size") % 3).alias("goodsImages"),
    )
    raw = S.read_raw_json(spark, json_arrays(records, scratch_path(spark, "raw")))
    return raw.select("goodsNo", "goodsNm", "price", F.endswith("file_path", F.lit(".txt")).alias("has_path"), F.size("goodsImages").alias("images"))


@register("read_json_docs", "SELECT doc_id, lang, text FROM documents")
def read_json_docs(spark, d):
    """Documents in files that hold an array each; any other root would fail the job."""
    path = json_arrays(D.table(spark, d, "documents").select("doc_id", "lang", "text"), scratch_path(spark, "docs"))
    return S.read_json_docs(spark, f"{path}/file=*", "doc_id long, lang string, text string")


@register(
    "export_log_file",
    with_(LOGS_SQL)
    + """SELECT '[' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '] [' || level || '] [' || service || '] ' || container || ' - ' || message AS value
FROM logs WHERE service = 'svc1' ORDER BY "timestamp" DESC, event_id DESC LIMIT 50000""",
)
def export_log_file(spark, d):
    path = scratch_path(spark, "logs")
    E.export_log_text(D.logs(spark, d), path, service="svc1", size=50_000)
    return spark.read.text(path)


@register("truncated_table", "SELECT p_partkey, p_name, CAST(0 AS BIGINT) AS rows_left FROM part")
def truncated_table(spark, d):
    """A copy is emptied; its (zero) rows are counted next to the rows it had."""
    path = scratch_path(spark, "empty")
    part = D.table(spark, d, "part").select("p_partkey", "p_name")
    T.append_table(part, path)
    T.truncate_tables(spark, [path])
    left = spark.read.parquet(path).select("p_partkey", F.lit(1).alias("__left"))
    return part.join(left, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("__left", F.lit(0)).cast("long").alias("rows_left"))


@register("scan_files", "SELECT CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes FROM part")
def scan_files(spark, d):
    """Files listed by extension and size below a folder, without their content."""
    path = scratch_path(spark, "files")
    D.table(spark, d, "part").select("p_name").write.text(path)
    found = S.scan_images(spark, path, extensions=("txt",), min_bytes=1)
    return found.agg(F.sum("length").alias("bytes"))
