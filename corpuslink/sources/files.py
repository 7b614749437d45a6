"""Sources and sinks: grids with a header row, typed JSON with a fallback, prose tables, version switches, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON records of a file; an empty table if it is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def normal_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def header_rows(grid: DataFrame, keywords: list[str], disclaimers: list[str], look: int = 20) -> DataFrame:
    """(source_file, sheet_name, header): first of ``look`` rows with two keyword cells (one if there are three cells at most) and no disclaimer."""
    full = F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    has = lambda words: lambda c: F.lower(c).rlike("|".join(words))
    hits = F.size(F.filter(full, has(keywords)))
    ok = (F.size(full) > 0) & ~F.exists(full, has(disclaimers)) & ((hits >= 2) | ((F.size(full) <= 3) & (hits >= 1)))
    return grid.filter((F.col("row_index") < look) & ok).groupBy("source_file", "sheet_name").agg(F.min("row_index").alias("header"))


def records(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(source_file, sheet_name, row_index, record): cells by normalised header key, empty ones left out, the last of equal keys wins."""
    sheet = ["source_file", "sheet_name"]
    keys = grid.join(headers, sheet).filter("row_index = header").select(*sheet, "header", F.transform("cells", lambda c: normal_key(F.coalesce(c, F.lit("")))).alias("keys"))
    rows = grid.join(keys, sheet).filter("row_index > header")
    cell = rows.select(*sheet, "row_index", F.posexplode(F.arrays_zip("keys", "cells")).alias("i", "p"))
    cell = cell.select(*sheet, "row_index", "i", F.col("p.keys").alias("k"), F.trim(F.col("p.cells")).alias("v")).filter("k != '' and v != ''")
    one = cell.groupBy(*sheet, "row_index", "k").agg(F.max_by("v", "i").alias("v"))
    return one.groupBy(*sheet, "row_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("record"))


def prose_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tab-separated rows that begin with a year: year, paper, number, area, question, marks (10 up to number 10, else 15)."""
    p = F.split(F.col(value), "\t")
    n = F.regexp_extract(F.get(p, 2), r"([0-9]+)", 1).try_cast("int")
    return lines.filter(F.col(value).rlike(r"^[0-9]{4}\t")).select(
        F.get(p, 0).cast("int").alias("year"), F.get(p, 1).alias("paper"), n.alias("number"), F.get(p, 3).alias("area"), F.get(p, 4).alias("question"),
        F.when(n <= 10, 10).otherwise(15).alias("marks"),
    )


def sectioned_bullets(lines: DataFrame, order: str = "n", value: str = "value", document: str = "doc") -> DataFrame:
    """Bullets with the section heading and the year above them."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    heading = F.when(v.startswith("## "), F.trim(F.substring(v, F.lit(4), F.length(v))))
    year = F.regexp_extract(v, r"^\*\*([0-9]{4})\*\*", 1).try_cast("int")
    rows = lines.withColumn("section", F.last(heading, True).over(w)).withColumn("year", F.last(year, True).over(w))
    return rows.filter(v.startswith("* ")).select(document, order, "section", "year", F.trim(F.substring(v, F.lit(3), F.length(v))).alias("prompt"))


def captured_questions(entries: DataFrame, body: str = "text") -> DataFrame:
    """(id, question) of capture bodies holding ``{pyqs: [...]}`` or one ``{id, question}``; first id wins by ``ord``."""
    many = F.from_json(body, "pyqs array<struct<id:string, question:string>>")["pyqs"]
    one = F.from_json(body, "id string, question string")
    found = F.coalesce(many, F.array(F.struct(one["id"].alias("id"), one["question"].alias("question"))))
    rows = entries.filter(F.length(body) > 2).select("ord", F.explode(found).alias("q")).select("ord", "q.id", "q.question").filter("id is not null and question is not null")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return rows.withColumn("r", rank).filter("r = 1").drop("r")


def content_digest(df: DataFrame) -> DataFrame:
    """(n, digest): order-free digest of all rows."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.struct("*")).cast("decimal(38,0)")).alias("digest"))


def publish(df: DataFrame, path: str, version: str) -> bool:
    """Write a version and point ``current`` at it, unless the current one has the same rows; says whether it wrote."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    pointer = f"{path}/current"
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(pointer)):
        now = spark.read.json(pointer).first()["version"]
        if content_digest(spark.read.parquet(f"{path}/{now}")).first() == content_digest(df).first():
            return False
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(pointer)
    return True


def keyed_json(df: DataFrame, path: str, key: str, ident: str, text: str, size: int = 120) -> None:
    """One JSON folder a key, and a compact index."""
    df.write.mode("overwrite").partitionBy(key).json(f"{path}/by_{key}")
    df.select(key, ident, F.substring(text, 1, size).alias(text)).write.mode("overwrite").json(f"{path}/index")


def keyed_update(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where ``updates`` has the key; write the result as a new version."""
    new = updates.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
