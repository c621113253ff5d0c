"""Exact dedup with an extendible-hash index kept in shared files.

1. ``staged``: every row is stored once with its key (XXH64 of the normalised text). Copies inside one Arrow batch are
   found on the spot by their SHA-256; only the first of them (the local representative) goes on.
2. ``directory``: key prefixes, doubled level by level; a bucket whose texts exceed its capacity is split on the next bit.
3. ``index``: owner tasks get whole buckets (ranges of keys) sorted by key, chain the different texts that share a key,
   and compare bytes. A task holds one chain at a time, whatever its bucket's size.
4. The group's row that stays is found by a map-side combined aggregate over narrow rows.

A group of any size sends one text per Arrow batch to its owner, never all its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import arrow_bytes, default_tasks, every_column, record_batch, slices, stored

#: Characters that do not count when texts are compared.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of distinct text a bucket may hold before it is split.
BUCKET_BYTES = 32_000_000
#: The directory has at most 2**MAX_DEPTH cells of 12 bytes: the proven bound for its broadcast.
MAX_DEPTH = 16

_INDEX = T.StructType().add("lid", "long").add("gid", "long").add("text_sha256", "string")


def normalised(text: bytes | None) -> bytes:
    """The text without blanks; null counts as empty."""
    return (text or b"").translate(None, BLANKS)


def stage_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with (row, seq, lid, key, n_points, is_rep), stored in the shared folder."""
    schema = (
        T.StructType().add("row", docs.schema).add("seq", "long").add("lid", "long").add("key", "long")
        .add("n_points", "long").add("is_rep", "boolean")
    )
    position = docs.columns.index(text_col)

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            local: dict[bytes, tuple[int, int]] = {}  # digest -> key and representative
            for part in slices([batch]):
                texts = arrow_bytes(part.column(0).flatten()[position])
                out: list[list] = [[], [], [], [], []]
                for text in texts:
                    body = normalised(text)
                    digest = hashlib.sha256(body).digest()
                    key, lid = local.get(digest, (None, seq))
                    if key is None:
                        key = xxhash.xxh64_intdigest(body) - (1 << 63)
                        local[digest] = (key, seq)
                    points = 0 if text is None else len(text.decode("utf-8", "surrogatepass"))
                    for column, value in zip(out, (seq, lid, key, points, lid == seq)):
                        column.append(value)
                    seq += 1
                yield record_batch(schema, [part.column(0).cast(_arrow_type(schema)), *out])

    return stored(docs.select(F.struct(*every_column(docs)).alias("row")).mapInArrow(staged, schema), "exact-rows")


def _arrow_type(schema: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema["row"].dataType)


def build_directory(reps: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """The directory's buckets as (depth, prefix): every key has exactly one bucket whose depth leading bits it has.

    Starts with one bucket; each round doubles the directory and splits the overfull buckets on their next bit. The
    driver holds bucket sizes only, at most 2**max_depth of them.
    """
    sizes = reps.groupBy(_prefix(max_depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")).collect()
    cells = {row["cell"]: row["n_bytes"] or 0 for row in sizes}
    full, buckets = [(0, 0)], []
    for depth in range(max_depth + 1):
        held: dict[int, int] = {}
        for cell, n in cells.items():
            prefix = cell >> (max_depth - depth)
            held[prefix] = held.get(prefix, 0) + n
        split = []
        for bucket in full:
            over = held.get(bucket[1], 0) > bucket_bytes and depth < max_depth
            (split if over else buckets).append(bucket)
        full = [(depth + 1, 2 * prefix + bit) for _, prefix in split for bit in (0, 1)]
    return sorted(buckets, key=lambda b: b[1] << (max_depth - b[0]))


def _prefix(depth: int):
    """The ``depth`` leading bits of the key, as an unsigned number."""
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - depth) if depth else F.lit(0)


def build_index(staged: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lid, gid, text_sha256) for every local representative; equal texts share gid. Stored by bucket."""
    spark = staged.sparkSession
    body = F.translate(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), BLANKS.decode(), "")
    reps = staged.where("is_rep")
    narrow = reps.select("key", F.octet_length(F.col("row")[text_col].cast("string")).cast("long").alias("n_bytes"))
    buckets = build_directory(narrow, bucket_bytes)
    cells = [
        (cell, number)
        for number, (depth, prefix) in enumerate(buckets)
        for cell in range(prefix << (MAX_DEPTH - depth), (prefix + 1) << (MAX_DEPTH - depth))
    ]
    directory = spark.createDataFrame(cells, "cell long, bucket int")
    owned = (
        reps.select("key", "lid", body.alias("body"), _prefix(MAX_DEPTH).cast("long").alias("cell"))
        .join(F.broadcast(directory), "cell")
        .select("bucket", "key", "lid", "body")
        .repartition(min(len(buckets), 16 * default_tasks(spark)), "bucket")
        .sortWithinPartitions("bucket", "key", "lid")
    )
    return stored(owned.mapInArrow(_chain, _INDEX), "exact-index")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, chain = None, []  # the different texts of the current key
    for part in slices(batches, text=3):
        out: list[list] = [[], [], []]
        for k, lid, body in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), arrow_bytes(part.column(3))):
            if k != key:
                key, chain = k, []
            found = next((link for link in chain if link[0] == body), None)
            if found is None:
                found = (body, lid, hashlib.sha256(body).hexdigest())
                chain.append(found)
            for column, value in zip(out, (lid, found[1], found[2])):
                column.append(value)
        yield record_batch(_INDEX, out)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The staged rows, and per local representative (lid): keep_id, keep_seq, group_size, text_sha256.

    Texts are equal if their bytes are equal after deleting blanks; null counts as empty, so null and blank texts are one
    group. Of a group the row with the most code points stays, then the smallest id (null ids last), then one of the
    repeated rows: exactly one row per group is kept. Other columns may hold nulls and have any name; an empty table
    gives an empty table.
    """
    staged = stage_rows(docs, text_col)
    index = build_index(staged, text_col, bucket_bytes)
    number = F.col("row")[id_col]
    rank = F.struct((-F.col("n_points")).alias("a"), number.isNull().alias("b"), number.alias("id"), F.col("seq").alias("seq"))
    local = staged.groupBy("lid").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    local = stored(local.join(index, "lid"), "exact-local")
    groups = local.groupBy("gid").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    decided = local.select("lid", "gid", "text_sha256").join(groups, "gid")
    decided = decided.select(
        "lid", F.col("best.id").alias("keep_id"), F.col("best.seq").alias("keep_seq"), "group_size", "text_sha256"
    )
    return staged, decided


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: the id column, keep_id, group_size, kept, text_sha256. Rules as in ``exact_groups``."""
    staged, decided = exact_groups(docs, id_col, text_col, bucket_bytes)
    members = staged.select(F.col("row")[id_col].alias(id_col), "seq", "lid")
    return members.join(decided, "lid").select(
        id_col, "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only the texts that stay are moved."""
    staged, decided = exact_groups(docs, id_col, text_col, bucket_bytes)
    stay = decided.select(F.col("keep_seq").alias("seq")).distinct()
    return staged.select("seq", "row").join(stay, "seq", "left_semi").select("row.*")
