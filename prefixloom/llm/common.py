"""What the corpus operators share: reading tables, checkpoints, Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a training sample that reach the driver; the order is by a hash of the id, so the sample is the same at every run.
SAMPLE_ROWS = 8000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one where it names none and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that is no longer read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, whatever else the table has; a null text is empty."""
    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def map_arrow(df: DataFrame, schema: str, rows: Callable[[list[list]], list[list]]) -> DataFrame:
    """mapInArrow over column lists: ``rows`` gets the columns of a batch and returns those of the result."""
    names = [part.split(":")[0].strip() for part in _fields(schema)]
    types = [_arrow(part.split(":")[1].strip()) for part in _fields(schema)]
    spark_schema = ", ".join(part.replace(":", " ", 1) for part in _fields(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in _slices(batch):
                out = rows([c.to_pylist() for c in small.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return df.mapInArrow(run, spark_schema)


def _slices(batch: pa.RecordBatch, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes, so that Python objects of long texts stay few."""
    step = max(1, int(len(batch) * limit / max(limit, batch.nbytes)))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def _fields(schema: str) -> list[str]:
    return [x.strip() for x in schema.split(",")]


def _arrow(kind: str) -> pa.DataType:
    simple = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    if kind.startswith("array<"):
        return pa.list_(simple[kind[6:-1]])
    return simple[kind]
