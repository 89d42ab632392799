"""Listing and writing of tables and files, and clusters of places."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import shared_dir


def scan_files(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """path, name, mtime and length of the files of these extensions (any case) under root. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return found.filter(kind.isin([e.lower().lstrip(".") for e in extensions])).select("path", name.alias("name"), F.col("modificationTime").alias("mtime"), "length")


def write_table(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """df as Parquet under path, a folder per value of `by`, one writer per value and slice of 32; read again."""
    slices = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(32)))
    slices.repartition(*by, "_slice").drop("_slice").write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_by_year(photos: DataFrame) -> DataFrame:
    """The photos written by year into a fresh shared folder; how many each year's folder holds."""
    back = write_table(photos.withColumn("year", F.year("captured")), shared_dir(photos.sparkSession), ["year"])
    return back.groupBy(F.col("year").cast("int").alias("year")).count().withColumnRenamed("count", "n")


def geo_kmeans(photos: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """photos with a valid place plus cluster: k-means in degrees with `most` clusters, at most 50 turns, a shift below 1e-6;
    as many photos as clusters or fewer are a cluster each. Seeding is k-means||."""
    valid = photos.filter(geo.is_valid_gps(F.col("lat"), F.col("lon")))
    few = valid.limit(most + 1)
    if few.count() <= most:
        return few.withColumn("cluster", F.monotonically_increasing_id())
    points = VectorAssembler(inputCols=["lat", "lon"], outputCol="_place").transform(valid)
    model = KMeans(k=most, maxIter=50, tol=1e-6, seed=seed, featuresCol="_place", predictionCol="_cluster").fit(points)
    return model.transform(points).withColumn("cluster", F.col("_cluster").cast("bigint")).drop("_place", "_cluster")
