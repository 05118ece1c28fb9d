"""Helpers shared by the operators: Arrow slices of bounded size, shared files, table access."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir, materialize, ship_package

#: Bytes of text that one step inside a Python task works on; longer single texts pass alone.
SLICE_BYTES = 4 << 20
#: Bound of one Arrow batch between the JVM and Python, against many long texts in a batch.
ARROW_BYTES = "16m"


def prepare(spark: SparkSession) -> None:
    """Ship the package, settle the shared folder, and bound Arrow batches by bytes."""
    ship_package(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, typed; other columns, whatever their names, stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(size):
            yield batch.slice(start)


def open_folder(uri: str):
    """(filesystem, path) of a shared folder: local mounts directly, others through Arrow."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage ends there."""
    return materialize(df, name)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
