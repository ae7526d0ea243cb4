"""Images of pixels derived from tables, and the usual planes beside them.

`pixels`: image_id, y, x, value (double), error (double), mask (boolean). A plane is a grid of `height` x `width`
pixels; cells without rows are 0. Values are whole cents over a power of two, so that plain sums of them are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All (y, x) of an image, made where they are used."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def image(spark: SparkSession, sf_dir: str, width: int = 32, height: int = 32, by: str | None = None) -> DataFrame:
    """The image of lineitem's prices: x from the order, y from the part; by: a column that makes one image for each of its values."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.col(by) if by else F.lit("all")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    cells = rows.groupBy(name.alias("image_id"), (F.col("l_partkey") % height).cast("int").alias("y"), (F.col("l_orderkey") % width).cast("int").alias("x")).agg((F.sum(cents) / 131072.0).alias("value"))
    images = cells.select("image_id").distinct() if by else spark.range(1).select(F.lit("all").alias("image_id"))
    full = images.crossJoin(F.broadcast(grid(spark, height, width))).join(cells, ["image_id", "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return full.withColumn("error", F.sqrt(F.abs("value"))).withColumn("mask", (F.col("x") * 7 + F.col("y") * 13) % 29 == 0)


def stamps(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """The vectors of embeddings read as small images, one for each vec_id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    return rows.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("at", "v")).select("image_id", (F.col("at") / width).cast("int").alias("y"), (F.col("at") % width).cast("int").alias("x"), F.col("v").cast("double").alias("value"))


def positions(spark: SparkSession, spec: list[tuple[int, float, float]]) -> DataFrame:
    """Sources (id, x, y) from a list."""
    return spark.createDataFrame(spec, "id long, x double, y double")
