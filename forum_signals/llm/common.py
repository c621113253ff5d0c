"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.session import scratch_path

#: Arrow rows taken at a time inside a task, so that working memory follows a few texts and not a whole batch.
SLICE_ROWS = 512
SLICE_BYTES = 4_000_000


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage: an executor lost later repeats nothing before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def every_column(df: DataFrame) -> list[Column]:
    return [column(name) for name in df.columns]


def arrow_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    wide = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(wide).to_pylist()


def slices(
    batches: Iterator[pa.RecordBatch], text: int | None = None, most: int = SLICE_BYTES, rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows and about ``most`` bytes of column ``text``.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        start, total = 0, batch.num_rows
        if not total:
            continue
        sizes = [0] * total if text is None else [x or 0 for x in _lengths(batch.column(text))]
        while start < total:
            end, held = start, 0
            while end < total and end - start < rows and (end == start or held + sizes[end] <= most):
                held += sizes[end]
                end += 1
            yield batch.slice(start, end - start)
            start = end


def _lengths(column: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def record_batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A record batch of the Spark schema from Python lists, numpy arrays or Arrow arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def id_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text (bucket 0)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def size_tasks(rows_or_bytes: int, per_task: int) -> int:
    """How many tasks hold the given amount at ``per_task`` each; at least one."""
    return max(1, -(-rows_or_bytes // per_task))


def default_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def limit_threads() -> None:
    """One thread per task for the numeric libraries; Spark already runs one task per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
