"""Sharding along a Hilbert curve.

Several metadata dimensions of a row are quantised to a few bits each by approximate quantiles (a sketch of fixed size) and
mapped to their index on the Hilbert curve; rows in curve order are cut into shards of equal row counts, and every
shard is written as runs: Parquet files that each cover a short stretch of the curve, so that their column
statistics are narrow in all the dimensions at once and a reader prunes files by any of them.

Nothing is ranked in one task: runs are cut by bytes from the sizes of the curve's cells, a cell with a third of all bytes
spreads over many runs by a hash of its rows, and ranks come from the row counts of the runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forum_signals.llm.common import every_column, size_tasks
from forum_signals.session import scratch_path

#: Bits per dimension.
BITS = 5
#: Text bytes of a run at most, unless one text is longer; the number of runs, and of the tasks that write them, grows with the data.
RUN_BYTES = 67_108_864


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer points, one row per point, coordinates below 2**bits.

    The coordinates are turned into the transposed index in place, from the highest bit down (undoing the
    rotations and reflections of the sub-cubes), Gray-decoded, and interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray, q = np.zeros_like(x[0]), top
    while q > 1:
        gray ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= gray
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def as_number(column: Column, kind: str) -> Column:
    """A number in the order of the column: strings by their first seven bytes, nulls as -1."""
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0")
        number = F.conv(head, 16, 10).cast("double")
    else:
        number = column.cast("double")
    return F.coalesce(F.when(F.isnan(number), F.lit(None)).otherwise(number), F.lit(-1.0))


def quantised(docs: DataFrame, numbers: dict[str, Column], bits: int) -> list[Column]:
    """Per dimension the number of quantile cuts at or below the value, from 0 to 2**bits - 1."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    asked = [F.percentile_approx(c, shares, 2000).alias(f"cut_{i}") for i, c in enumerate(numbers.values())]
    cuts = docs.agg(*asked).first()
    cells = []
    for i, column in enumerate(numbers.values()):
        edges = sorted(set(cuts[i] or []))
        total = F.lit(0)
        for edge in edges:
            total = total + (column >= F.lit(float(edge))).cast("int")
        cells.append(total)
    return cells


def _curve(bits: int):
    @F.pandas_udf("long")
    def curve(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits)) if len(cells) else pd.Series([], dtype="int64")

    return curve


def cut_runs(cells: list[tuple[int, int]], run_bytes: int) -> tuple[list[tuple[int, int, int]], int]:
    """(curve, first run, parts) of each cell, given its bytes in curve order, and the number of runs.

    Neighbouring cells share a run as long as it holds at most ``run_bytes``; a larger cell is a stretch of runs of its own,
    one for each part of its rows.
    """
    placed, runs, held = [], 0, 0
    for curve, size in cells:
        parts = size_tasks(size, run_bytes)
        if held and (parts > 1 or held + size > run_bytes):
            runs, held = runs + 1, 0
        placed.append((curve, runs, parts))
        if parts > 1:
            runs += parts
        else:
            held += size
    return placed, runs + (held > 0)


def write_shards(
    docs: DataFrame, path: str, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = 8,
    bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", law: str = "rows", runs: int | None = None,
) -> DataFrame:
    """Write ``docs`` as Parquet runs in curve order below ``path`` and return one row per row, read from the files.

    Columns of the result: the id column, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32
    (unsigned; a null text counts as empty), curve (the Hilbert index), shard, slot (position in the shard, gapless from 0), run.
    ``law`` is ``rows`` (shards differ by at most one row; the first ones take the surplus) or ``bytes`` (a row goes to the
    shard its first byte falls in, when all sizes are laid end to end). Ties on the curve are ordered by id (nulls
    first) and checksum within a run; repeated rows stay repeated. The files hold the whole rows in ``row``, whatever their columns are
    called. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    numbers = {name: as_number(F.col(f"`{name}`"), kinds[name]) for name in dimensions}
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    curve = _curve(bits)(F.array(*quantised(docs, numbers, bits)))
    # one row per cell of the curve: at most 2**(bits * dimensions), whatever the data
    found = docs.select(curve.alias("curve"), size.alias("size")).groupBy("curve").agg(F.sum("size").alias("size")).orderBy("curve").collect()
    total = sum(r["size"] for r in found)
    cells, runs = cut_runs([(r["curve"], r["size"]) for r in found], size_tasks(total, runs) if runs else RUN_BYTES)
    cuts = F.broadcast(spark.createDataFrame(cells, "curve long, first int, parts int"))
    placed = docs.select(
        F.struct(*every_column(docs)).alias("row"), F.col(f"`{id_col}`").alias("id"), size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), curve.alias("curve"),
    ).join(cuts, "curve")
    part = F.pmod(F.xxhash64("id", "text_crc32"), F.col("parts")).cast("int")
    order = ["curve", "id", "text_crc32"]
    targeted = placed.withColumn("target", F.col("first") + part).drop("first", "parts")
    ordered = targeted.repartitionById(max(1, runs), F.col("target")).drop("target").sortWithinPartitions(*order)
    position = F.monotonically_increasing_id()
    ordered.select(
        "*", F.shiftright(position, 33).cast("int").alias("run"), position.bitwiseAND((1 << 33) - 1).alias("at")
    ).write.option("compression", "zstd").parquet(path)
    files = spark.read.parquet(path).select("id", "size", "text_crc32", "curve", "run", "at")

    # One row per run, as many as there are files: the manifest from which ranks follow.
    held = {r["run"]: (r["n"], r["b"]) for r in files.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
    manifest, rows, size = [], 0, 0
    for run in sorted(held):
        manifest.append((run, rows, size))
        rows, size = rows + held[run][0], size + held[run][1]
    starts = F.broadcast(spark.createDataFrame(manifest, "run int, rows_before long, bytes_before long"))
    ranked = files.join(starts, "run")
    rank = F.col("rows_before") + F.col("at")
    if law == "rows":
        least, surplus = divmod(rows, shards)
        wide = (least + 1) * surplus  # the rows of the shards that take one more
        shard = F.when(rank < wide, F.floor(rank / (least + 1))).otherwise(surplus + F.floor((rank - wide) / max(1, least)))
        first = F.when(F.col("shard") < surplus, F.col("shard") * (least + 1)).otherwise(wide + (F.col("shard") - surplus) * least)
        out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - first).cast("long"))
    elif law == "bytes":
        out = _by_bytes(ranked, shards, max(1, size))
    else:
        raise ValueError(f"law must be rows or bytes, not {law}")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", "slot", "run")


def _by_bytes(ranked: DataFrame, shards: int, total: int) -> DataFrame:
    from pyspark.sql import Window

    inside = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = ranked.withColumn("shard", F.floor(offset * shards / total).cast("int"))
    first = placed.groupBy("shard").agg(F.min(F.col("rows_before") + F.col("at")).alias("first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rows_before") + F.col("at") - F.col("first"))
