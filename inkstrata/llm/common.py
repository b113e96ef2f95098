"""What the operators share: shared storage, samples of labelled rows, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master is local (tests); an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        # qualified: a path without a scheme means the cluster's file system, also to readers beside Spark
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub("^file:/+", "file:///", whole).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="inkstrata-")
    return "file://" + _LOCAL["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor takes nothing with it. Nobody else waits for it, so it has no _SUCCESS file: with local storage that costs the driver processes."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches: long texts must not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, after which freed memory goes back to the system (where its C library can): Python workers live on from task to task and stage to stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return run


def map_text(df: DataFrame, fn: Callable[[list], list[tuple] | dict], schema: str, *, keep: list[str], text: str, budget: int = 1 << 18) -> DataFrame:
    """fn gets lists of whole texts (None stays None) of about ``budget`` characters in all, and returns a dict of result columns.

    The columns in ``keep`` pass through. A single longer text makes a list of its own.
    """

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            at = batch.schema.get_field_index(text)
            lo = 0
            while lo < n:
                part: list = []
                size = 0
                hi = lo
                column = batch.column(at)
                while hi < n and (hi == lo or size < budget):
                    value = column[hi].as_py()
                    part.append(value)
                    size += len(value or "") + 16
                    hi += 1
                made = fn(part)
                arrays = []
                for field in target:
                    if field.name in made:
                        arrays.append(pa.array(made[field.name], type=field.type))
                    else:
                        arrays.append(batch.column(batch.schema.get_field_index(field.name)).slice(lo, hi - lo).cast(field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
                lo = hi

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(trimmed(run), schema)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stratified(df: DataFrame, key: str, stratum: str, bound: int, most_strata: int = 500) -> DataFrame:
    """About ``bound`` rows of each stratum (all of smaller ones), picked by a hash of the key: no sort, the same rows each time.

    Rows whose stratum is null go. ``most_strata`` bounds what the driver holds (one count each); more raise an error.
    """
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().limit(most_strata + 1).collect()
    if len(counts) > most_strata:
        raise ValueError(f"{stratum} has more than {most_strata} values")
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30))
    kept = F.lit(False)
    for value, count in counts:
        kept = kept | ((F.col(stratum) == F.lit(value)) & (draw < int(min(1.0, bound / count) * (1 << 30))))
    return df.where(kept)
