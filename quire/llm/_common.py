"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ascii_lower(column):
    """Lower-cases A-Z only.  ASCII-only text takes the byte-wise built-in; other text a per-character map."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def let(value, body):
    """Binds a value once for a body that uses it inside lambdas, where the optimizer would repeat the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_text(df: DataFrame, key: str, text: str, fn: Callable[[str], tuple], fields: list[tuple[str, str]], once: Callable | None = None) -> DataFrame:
    """Applies ``fn`` to every whole text and returns the key with one column per field.

    Rows are streamed through Arrow in batches, so memory is bounded by a
    batch.  A null text is handed over as ''.  Only the two named columns are
    read, so other columns cannot clash with the result.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kinds = [_parse_datatype_string(kind) for _, kind in fields]
    arrow = [to_arrow_type(kind) for kind in kinds]
    schema = StructType([StructField(key, source.schema["k"].dataType)] + [StructField(n, k) for (n, _), k in zip(fields, kinds)])
    names = [key] + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t if t is not None else "") for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, a) for c, a in zip(columns, arrow)], names=names)

    return source.mapInArrow(run, schema)


def scratch(spark: SparkSession) -> str:
    """A folder for cut lineage: below spark.checkpoint.dir where the cluster names one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, folder: str) -> None:
    """Has a folder removed when the application ends, since a result may read it until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Removes folders that ``cut`` wrote and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
