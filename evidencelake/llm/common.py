"""What several operators share: scratch tables, word pattern, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster must name one,
    because executors do not share local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="evidencelake-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """df as a written table in the shared folder, with a part for each value of ``by``: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables below the shared folder; call it once all that was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        own = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/".removeprefix("file://")
        for folder in {f.rpartition("/")[0] for f in table.inputFiles() if own in f}:
            _delete(spark, folder)


def release_scratch(spark: SparkSession) -> None:
    """Delete the written tables of this application; call it once their readers are done."""
    _delete(spark, f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}")


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def id_text(doc_id: Column) -> Column:
    """CRC-32 of doc_id written as decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def slices(stream: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of them stays small."""
    for b in stream:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def utf8_parts(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string or binary column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
