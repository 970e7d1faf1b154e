"""Readers: CSV tables with fixed schemas, document folders and nested catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skuflow.session import compute_partitions
from skuflow.sources import schemas

#: Tasks that read a folder of files, times the shuffle partitions, at most.
READ_TASKS = 16


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Columns are matched by header name, so files may hold them in any order or hold fewer. All files of a
    # folder must agree; a file with another header is an error instead of shifted columns.
    header = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path).columns
    by_name = {field.name: field for field in schema}
    unknown = T.StringType()
    file_schema = T.StructType([by_name.get(name, T.StructField(name, unknown)) for name in header])
    # Quoted cells may hold commas, doubled quotes and line breaks. A cell that its column's type can't hold is an
    # error that names the row, not a silent null.
    options = {
        "header": True, "encoding": "UTF-8", "enforceSchema": False, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST",
    }
    return spark.read.options(**options).schema(file_schema).csv(path)


def read_demand(spark: SparkSession, path: str) -> DataFrame:
    """Monthly demand per SKU; ``period`` becomes the first day of its month."""
    return _csv(spark, path, schemas.DEMAND).withColumn("period", F.to_date("period", "yyyy-MM"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return _with_dates(_csv(spark, path, schemas.INVENTORY), "snapshot_date")


def read_supplier_directory(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SUPPLIER_DIRECTORY)


def read_supplier_terms(spark: SparkSession, path: str) -> DataFrame:
    """Supplier terms; ``sku_list`` holds the delimited SKU text as an array."""
    df = _with_dates(_csv(spark, path, schemas.SUPPLIER_TERMS), "price_valid_until", "last_audit_date")
    return df.withColumn("sku_list", sku_list(F.col("skus_supplied")))


def read_purchase_orders(spark: SparkSession, path: str, date_pattern: str = "yyyy-MM-dd") -> DataFrame:
    return _with_dates(_csv(spark, path, schemas.PURCHASE_ORDERS), "po_date", pattern=date_pattern)


def read_sales_invoices(spark: SparkSession, path: str, date_pattern: str = "yyyy-MM-dd") -> DataFrame:
    return _with_dates(_csv(spark, path, schemas.SALES_INVOICES), "invoice_date", pattern=date_pattern)


def _with_dates(df: DataFrame, *names: str, pattern: str = "dd-MM-yyyy") -> DataFrame:
    for name in names:
        if name in df.columns:
            df = df.withColumn(name, F.to_date(name, pattern))
    return df


def sku_list(text: Column) -> Column:
    """``"A; B"`` as an array of codes."""
    return F.filter(F.split(text, r";\s*"), lambda code: F.trim(code) != "")


def _source_of(path: Column) -> Column:
    folder = F.regexp_extract(path, "/source=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1))


def read_pages(
    spark: SparkSession, directory: str, extension: str = ".txt", page_break: str = "\f", nested: bool = False
) -> DataFrame:
    """Text files of a folder, each opened once: one row per page, and one with a ``reason`` for a file that can't be read.

    One page per form feed. The source is a file's name, or that of its folder where ``sinks.save_documents`` wrote it. A folder
    without matching files raises ``FileNotFoundError``. With ``nested``, files of all subfolders count and Spark needn't find
    out columns from folder names; that is meant for what ``sinks.save_documents`` wrote.
    """
    files = (
        spark.read.format("binaryFile")
        .options(pathGlobFilter=f"*{extension}", recursiveFileLookup=nested)
        .load(directory)
        .select(_source_of(F.col("path")).alias("source"), "path", "content")
    )
    if not files.select("path").take(1):
        raise FileNotFoundError(f"no {extension} files in {directory}")
    # Spark counts a small file as megabytes, which makes a task of a few of them.
    dealt = files.coalesce(READ_TASKS * compute_partitions(spark))
    # try_validate_utf8 gives null on bytes that are not UTF-8.
    body = F.try_validate_utf8(F.col("content").cast("string"))
    return dealt.withColumn("body", body).select(
        "source", "path", F.posexplode_outer(F.split("body", page_break)).alias("page", "text"),
        F.when(F.col("body").isNull(), "not UTF-8 text").alias("reason"),
    )


def read_documents(
    spark: SparkSession, directory: str, extension: str = ".txt", page_break: str = "\f", nested: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``read_pages`` as ``(pages, rejects)``: a file whose bytes are not UTF-8 goes to ``rejects`` and the others are kept."""
    read = read_pages(spark, directory, extension, page_break, nested)
    rejects = read.where(F.col("reason").isNotNull()).select("source", "path", "reason")
    return read.where(F.col("reason").isNull()).drop("reason"), rejects


def explode_catalog(catalogs: DataFrame) -> DataFrame:
    """One row per product of each nested catalog, with the supplier columns kept."""
    kept = [name for name in catalogs.columns if name != "products"]
    return catalogs.select(*kept, F.explode("products").alias("product")).select(*kept, "product.*")
