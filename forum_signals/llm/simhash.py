"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits in two 32-bit segments, and every segment has a table from its value to the fingerprints with that value. Of two
fingerprints that differ in at most two bits either one segment is equal, or both differ in one bit. So every
fingerprint fetches from the first table the values in the radius-1 Hamming ball of its first segment (33 of them) and from the second
table its own value, and each match is verified by its complete distance.

A segment value of more than HOT_VALUE different fingerprints is not fetched, as all pairs of them would be matches. Whoever is in or
would have fetched such a value is entered under all 64-bit values in its radius-1 ball instead: two fingerprints within two bits share one of
those entries, its members (65 at most) are all within two bits of each other, and each is linked to the next one only.
Components of the links are then the components of the full link graph. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import arrow_bytes, column, every_column, record_batch, slices, stored
from forum_signals.llm.components import connected_components

SEED = 42
#: Shingles whose bits are added up at a time, so that a very long text needs no more memory than this.
SHINGLE_BLOCK = 65_536
#: Words of a shingle, and bits in which linked fingerprints may differ: the segments above are laid out for two.
WIDTH = 3
DISTANCE = 2
#: Different fingerprints with one segment value up to which all of them are fetched.
HOT_VALUE = 64


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in blocks. Words are lower-cased (A-Z) and split at ASCII blanks."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    for at in range(0, len(spans), SHINGLE_BLOCK):
        part = spans[at : at + SHINGLE_BLOCK]
        digest = xxhash.xxh64_intdigest
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in part), dtype=np.uint64, count=len(part))


def fingerprint(text: bytes | None, width: int) -> int:
    """Bit i is 1 if it is set in over half the shingle hashes; a text without words has fingerprint zero."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    if not total:
        return 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The columns ``carry`` of every row and its fingerprint ``fp`` as a signed long."""
    chosen = docs.select(F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType().add(chosen.schema["row"]).add("fp", "long")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1):
            fps = [fingerprint(text, width) for text in arrow_bytes(part.column(1))]
            yield record_batch(schema, [part.column(0), np.array(fps, dtype=np.uint64).view(np.int64)])

    return chosen.mapInArrow(scored, schema)


def _bit(number: int) -> Column:
    """A long with one bit set."""
    return F.lit((1 << number) - (1 << 64) if number == 63 else 1 << number)


def _segments() -> tuple[Column, Column]:
    return F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))


def segment_matches(values: DataFrame, hot_value: int = HOT_VALUE) -> tuple[DataFrame, DataFrame]:
    """(fp, other) of all table matches of the different fingerprints ``values``, and (fp) of those that hot values leave to ``_chained``."""
    first, second = _segments()
    table = values.select(F.explode(F.array(F.struct(F.lit(0).alias("segment"), first.alias("value")), F.struct(F.lit(1).alias("segment"), second.alias("value")))).alias("at"), "fp")
    table = table.select("at.segment", "at.value", "fp")
    hot = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_value)
    hot = stored(hot.select("segment", "value"), "simhash-hot")
    ball = F.array(first, *[first.bitwiseXOR(F.lit(1 << bit)) for bit in range(32)])
    probes = values.select(F.lit(0).alias("segment"), F.explode(ball).alias("value"), "fp").union(values.select(F.lit(1), second, "fp"))
    cold_table = table.join(hot, ["segment", "value"], "left_anti").withColumnRenamed("fp", "other")
    matches = probes.join(cold_table, ["segment", "value"]).where("fp > other").select("fp", "other")
    near_hot = probes.join(hot, ["segment", "value"], "left_semi").select("fp").distinct()
    return matches, near_hot


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def _chained(values: DataFrame) -> DataFrame:
    """(fp, other): every fingerprint and the one before it in each entry of its radius-1 ball."""
    entry = F.explode(F.array(F.lit(0).cast("long"), *map(_bit, range(64))))
    entries = values.select(entry.alias("flip"), "fp").select(F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"), "fp")
    before = F.lag("fp").over(Window.partitionBy("entry").orderBy("fp"))
    return entries.select("fp", before.alias("other")).where("other IS NOT NULL")


def links(prints: DataFrame, hot_value: int = HOT_VALUE) -> DataFrame:
    """(a, b) links between different fingerprints of column ``fp``; enough of them to connect whatever is within two bits."""
    values = stored(prints.select("fp").distinct(), "simhash-values")
    matches, near_hot = segment_matches(values, hot_value)
    found = matches.union(_chained(near_hot)).where(_near("fp", "other"))
    return found.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_groups(prints: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints that have a link; equal root means connected."""
    return connected_components(links(prints), "simhash-links").select(
        F.col("node").alias("fp"), F.col("component").alias("root")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: the id column, fingerprint (16 hex digits), component_id.

    Fingerprints link at two or fewer differing bits; component_id is the smallest id reachable over links, the row's own
    included; null ids count as largest and a component of null ids only has a null component_id. Null, empty and blank
    texts have fingerprint zero and link like any other. Repeated rows give repeated rows. Extra columns are ignored, an
    empty table gives an empty table. Whole texts count, whatever their length.
    """
    prints = stored(fingerprints(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), ["id"], "text", width), "simhash")
    prints = prints.select(F.col("row.id").alias("id"), "fp")
    rooted = least_ids(prints)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(rooted, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def least_ids(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint of (id, fp): the smallest id of its component."""
    groups = near_groups(prints)
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    named = least.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-groups")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(roots, "root").select("fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component of linked fingerprints the row with the smallest id stays.

    Fingerprints, links and components are those of ``near_duplicates``. Null, empty and blank texts are one component with all others of fingerprint
    zero. Null ids come last; of rows with one id the first one stays. Columns are those of ``docs``, whatever their names; an empty table gives
    an empty table.
    """
    named = docs.select(F.struct(*every_column(docs)).alias("doc"), column(id_col).alias("id"), column(text_col).alias("text"))
    rows = stored(fingerprints(named, ["doc", "id"], "text", width).withColumn("seq", F.monotonically_increasing_id()), "simhash-rows")
    rank = F.struct(F.col("row.id").isNull().alias("last"), F.col("row.id").alias("id"), "seq")
    # one row per fingerprint before groups are formed, however many rows have it
    least = stored(rows.groupBy("fp").agg(F.min(rank).alias("least")), "simhash-least")
    rooted = stored(least.join(near_groups(least), "fp", "left").select("least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    kept = rooted.groupBy("root").agg(F.min("least").alias("best")).select(F.col("best.seq").alias("seq"))
    return rows.join(kept, "seq", "left_semi").select("row.doc.*")
