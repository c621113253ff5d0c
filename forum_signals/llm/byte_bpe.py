"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks that overlap by OVERLAP characters; every chunk is a row of its own and is pre-tokenised
where it lies. A chunk's first boundaries can be wrong, since it may begin inside a pre-token, but pre-tokenising is
deterministic from any boundary on: at the first position in the overlap at which both neighbours start a pre-token they
have resynchronised, and the left one hands over to the right one there. Each chunk then encodes the pre-tokens
between its two hand-over points, and a document's pieces are put together in order. Documents in which two neighbours
never meet (a pre-token longer than the overlap) are encoded whole. Decoding concatenates the tokens' raw bytes.

Texts of at most one chunk need none of this and are encoded where they are read, without a shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import column, every_column, record_batch, slices, stored

CHUNK = 32_768
OVERLAP = 1_024
#: Distinct pre-tokens a task remembers; forgotten all at once beyond that.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Pre-tokenises, encodes and decodes; built once per Python worker by ``codec``."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        tokens = [self.bytes_of.get(rank) for rank in range(max(self.bytes_of) + 1)]
        self.tokens = pa.array(tokens, type=pa.large_binary())
        self.remembered = _Remembered(self.library)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        return b"".join(map(self.remembered.__getitem__, self.pattern.findall(text)))

    def boundaries(self, text: str) -> np.ndarray:
        """Where the pre-tokens of ``text`` start."""
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), dtype=np.int64)


class _Remembered(dict):
    """Pre-token -> ids as bytes, asked from the library once each."""

    def __init__(self, library: tiktoken.Encoding):
        super().__init__()
        self.library = library

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.library.encode_ordinary(piece), dtype="<i4").tobytes()
        return ids


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """One list of ids per row, from their bytes."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
    return pa.ListArray.from_arrays(ends, flat).cast(pa.list_(pa.field("element", pa.int32())))


def joined(lists: pa.ListArray, pieces: pa.Array) -> list[bytes | None]:
    """Per row the concatenated ``pieces`` of its numbers: they are laid end to end at once and cut at the rows' ends."""
    ends = lists.offsets.to_numpy()
    laid = pieces.take(lists.values.slice(ends[0], ends[-1] - ends[0]))
    places = np.frombuffer(laid.buffers()[1], dtype=np.int64)[: len(laid) + 1] if len(laid) else np.zeros(1, dtype=np.int64)
    data = memoryview(laid.buffers()[2]) if len(laid) else memoryview(b"")
    cuts = places[ends - ends[0]].tolist()
    return [bytes(data[a:b]) if valid else None for a, b, valid in zip(cuts, cuts[1:], lists.is_valid().to_pylist())]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with its token ids ``ids`` (array of int).

    Each match of ``pattern`` is encoded separately by the ranks in ``path``, without special tokens. Null and empty texts
    have no ids. Rows are neither merged nor dropped; other columns may hold nulls and have any name. No text is cut.
    """
    whole = docs.select(F.struct(*every_column(docs)).alias("row"), column(text_col).cast("string").alias("text"))
    schema = T.StructType().add(whole.schema["row"]).add("ids", T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches, text=1):
            ids = [own.encode(text or "") for text in part.column(1).to_pylist()]
            yield record_batch(schema, [part.column(0), id_lists(ids)])

    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    short = whole.where(~is_long).mapInArrow(encoded, schema)
    long = stored(whole.where(is_long).withColumn("seq", F.monotonically_increasing_id()), "bpe-long")
    pieces = _encode_chunks(long, path, pattern, chunk, overlap)
    met = pieces.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    met = met.select("seq", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    stitched = long.select("seq", "row").join(met, "seq").select("row", "ids")
    rest = long.join(pieces.select("seq").distinct(), "seq", "left_anti").select("row", "text").mapInArrow(encoded, schema)
    return short.unionByName(stitched).unionByName(rest)


def _safe(text: str, starts: np.ndarray) -> np.ndarray:
    """The boundaries that do not follow a blank.

    The pattern looks past a run of blanks to decide where it ends, and nowhere else; a text that is cut after any other
    character has the same matches on both sides as the whole.
    """
    return np.array([s for s in starts.tolist() if s and not text[s - 1].isspace()], dtype=np.int64)


def _encode_chunks(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(seq, k, ids) for all chunks of the documents whose chunks all resynchronise."""
    last = F.ceil((F.length("text") - overlap) / chunk) - 1
    chunks = long.select("seq", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k"), last.cast("int").alias("last"))
    chunks = chunks.select("seq", "k", "last", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))
    schema = (
        T.StructType().add("seq", "long").add("k", "integer").add("last", "integer").add("piece", "string")
        .add("head", T.ArrayType(T.IntegerType())).add("tail", T.ArrayType(T.IntegerType()))
    )

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches, text=3):
            texts = part.column(3).to_pylist()
            starts = [_safe(text, own.boundaries(text)) for text in texts]
            heads = [s[s < overlap].astype(np.int32) for s in starts]
            tails = [(s[s >= chunk] - chunk).astype(np.int32) for s in starts]
            yield record_batch(schema, [*part.columns, heads, tails])

    spread = chunks.repartition("seq", "k")
    cut = stored(spread.mapInArrow(started, schema), "bpe-chunks")
    left = cut.select("seq", (F.col("k") + 1).alias("k"), "tail")
    inner = cut.select("seq", "k", "last", "head").join(left, ["seq", "k"])
    meets = inner.select("seq", "k", F.array_min(F.array_intersect("head", "tail")).alias("at"))
    complete = meets.groupBy("seq").agg(F.every(F.col("at").isNotNull()).alias("met")).where("met").select("seq")
    meets = stored(meets.join(complete, "seq"), "bpe-meets")
    begins = meets.select("seq", "k", F.col("at").alias("begin"))
    ends = meets.select("seq", (F.col("k") - 1).alias("k"), (F.col("at") + chunk).alias("end"))
    out = T.StructType().add("seq", "long").add("k", "integer").add("ids", T.ArrayType(T.IntegerType()))
    owned = (
        cut.select("seq", "k", "piece").join(begins, ["seq", "k"], "left").join(ends, ["seq", "k"], "left")
        .where("begin IS NOT NULL OR end IS NOT NULL")
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches, text=2):
            seq, k, pieces, begin, end = (column.to_pylist() for column in part.columns)
            ids = [own.encode(p[b or 0 : e]) for p, b, e in zip(pieces, begin, end)]
            yield record_batch(out, [seq, k, id_lists(ids)])

    return stored(owned.mapInArrow(encoded, out), "bpe-pieces")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with one more column, ``decoded`` (binary): the raw bytes of all its tokens; null ids give null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    position = encoded.columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches):
            yield record_batch(schema, [*part.columns, joined(part.column(position), own.tokens)])

    return encoded.mapInArrow(decoded, schema)
