"""Nested records kept as Parquet, one for each area. Writing an area again replaces its record and no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from terraloom.sources.staging import stage

BUCKETS = 64


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def put(records: DataFrame, path: str, id_col: str = "aoi_id", buckets: int = BUCKETS) -> None:
    """Add or replace the records of areas. Folders are buckets of the areas' hash; only those of the given areas are written.

    Rows with a null id are left out; of rows of one id one is kept. buckets must be the same in all calls for a folder. Writers must
    take turns, as each bucket is read and replaced; what is read is staged first, so a failed write can be repeated.
    """
    spark = records.sparkSession
    new = stage(records.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).withColumn("bucket", _bucket(id_col, buckets)))
    if exists(spark, path):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        kept = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)).join(new.select(id_col), id_col, "left_anti")
        new = stage(kept.select(*new.columns).unionByName(new))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def get(spark: SparkSession, path: str, schema: StructType, id_col: str = "aoi_id", ids: list | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The records, or those of some areas; only their buckets are read then."""
    found = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)
    if ids is not None:
        kind = found.schema[id_col].dataType
        wanted = spark.range(1).select(F.explode(F.array(*(F.lit(i).cast(kind) for i in ids))).alias(id_col)).select(_bucket(id_col, buckets).alias("b"))
        found = found.where(F.col("bucket").isin([r["b"] for r in wanted.distinct().collect()]) & F.col(id_col).isin(ids))
    return found.drop("bucket")
