"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of the largest file that is taken
CEILING = 25 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, length, content of the .pdf files (in either case) that are not too large; contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("length") <= CEILING).withColumnRenamed("modificationTime", "modified")


def lookup(products: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The products with a given id; ids are trimmed, blank ones dropped, each counts once."""
    wanted = ids.select(F.trim(F.col(key).cast("string")).alias("_id")).where("_id <> ''").distinct()
    return products.join(wanted, F.col(key).cast("string") == F.col("_id"), "left_semi")


def landed(df: DataFrame) -> DataFrame:
    """Writes rows that several branches read to the shared folder of spark.checkpoint.dir, and reads them back from there.

    The folder is removed when the application ends.
    """
    import tempfile
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, folder: str, version: str) -> str:
    """Writes a whole new version beside the old ones and returns its folder; readers switch by that name."""
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path
