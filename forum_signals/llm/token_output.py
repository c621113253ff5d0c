"""Token ids as ORC files.

Every document is one row (doc id, token ids) of ORC files written in ascending order of document ids. ORC stores the ids with its
integer run-length encoding, and each file carries stripes that tasks can read in parallel, row indexes every ROW_INDEX
rows and Bloom filters on the document id, so that a lookup reads the few row groups that can hold the document. Files are cut by
ranges of document ids: their statistics do not overlap, and a range of documents touches the files of that range only.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from forum_signals.llm.common import arrow_bytes, default_tasks, limit_threads, record_batch, slices

STRIPE_BYTES = 16_777_216
ROW_INDEX = 1_000
#: Distinct words a Python worker remembers, over all its tasks; forgotten all at once beyond that.
REMEMBERED = 1_000_000

_FILE = (
    T.StructType().add("id", "long").add("run", "integer").add("at", "long").add("n_tokens", "long")
    .add("ids", T.ArrayType(T.IntegerType()))
)
_DIGEST = (
    T.StructType().add("id", "long").add("run", "integer").add("at", "long").add("n_tokens", "long").add("ids_crc32", "long")
)


#: Words of these characters only are normalised here instead of in the library: printable ASCII and the Latin letters
#: that have one code point, one lower case and no accent to compose.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Fixed value: the tokenizer file's pattern, restricted to those characters in lower case.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Texts and bytes whose words are numbered together; a single longer text is worked on alone.
BULK_ROWS = 8_192
BULK_BYTES = 16_000_000
#: Words asked for in one call.
CALL_WORDS = 2_000


class Words(dict):
    """Blank-separated word -> its ids as bytes. Such words are encoded independently of each other, so each is asked for once.

    The library's merges do the work. Most of its time goes to normalising and splitting, which for plain words
    comes to lower case and a pattern; other words go through the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        self.pieces: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(names) or "(?!)")
        letters = [chr(c) for c in range(0xC0, 0x100)]
        self.shown = str.maketrans({c: "".join(map(_byte_symbol, c.encode())) for c in letters})

    def encode(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        """The ids of each text and then ``end``, as little-endian 32-bit integers."""
        ids, edges = self.end_to_end(pa.array(texts, type=pa.large_binary()).cast(pa.large_string()))
        return [ids[a:b].tobytes() + end for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def end_to_end(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins and the last one ends.

        Words are split and numbered in bulk, so that each distinct word of a slice is looked up once.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        names = _byte_strings(coded.dictionary)
        if len(self) > REMEMBERED:
            self.clear()
        found = list(map(self.get, names))
        unseen = [name for name, ids in zip(names, found) if ids is None]
        for at in range(0, len(unseen), CALL_WORDS):
            self._ask(unseen[at : at + CALL_WORDS])
        if unseen:
            found = list(map(self.__getitem__, names))
        known = np.frombuffer(b"".join(found), dtype="<i4")
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        words = coded.indices.to_numpy()
        counts = lengths[words]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = (np.cumsum(lengths) - lengths)[words] - ends[:-1]
        shift = np.repeat(shift, counts)
        shift += np.arange(len(shift))
        return known[shift], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def _ask(self, raw: list[bytes]) -> None:
        texts = [word.decode("utf-8") for word in raw]
        plain = [PLAIN.fullmatch(t) is not None and self.special.search(t) is None for t in texts]
        other = [(r, t) for r, t, p in zip(raw, texts, plain) if not p]
        for (r, _), found in zip(other, self.library.encode_batch_fast([t for _, t in other], add_special_tokens=False)):
            self[r] = np.array(found.ids, dtype="<i4").tobytes()
        known = [(r, PIECES.findall(t.lower())) for r, t, p in zip(raw, texts, plain) if p]
        self._merge(set().union(*(own for _, own in known)).difference(self.pieces))
        get = self.pieces.__getitem__
        self.update((r, get(own[0]) if len(own) == 1 else b"".join(map(get, own))) for r, own in known)

    def _merge(self, unseen: set[str]) -> None:
        """Ask the library's merges for the pieces not seen yet, which many words share."""
        merged = self.library.model.tokenize
        for piece in unseen:
            tokens = merged(piece if piece.isascii() else piece.translate(self.shown))
            self.pieces[piece] = struct.pack(f"<{len(tokens)}i", *[t.id for t in tokens])

    def clear(self) -> None:
        super().clear()
        self.pieces.clear()


def _byte_strings(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column without nulls."""
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _byte_symbol(byte: int) -> str:
    """The character that byte-level vocabularies write for a byte above 127: itself, or the next free one above 255."""
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return chr(256 + hidden.index(byte)) if byte in hidden else chr(byte)


_words: dict[str, Words] = {}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> None:
    """Encode every whole text and write the ids as ORC below ``path``, one row per input row.

    Null and empty texts are the end id alone. Rows come in ascending id (null ids first, equal ids by the text's
    hash); repeated rows stay repeated. Columns of the files: id, run (number of the file's range), at (ids before
    the row in its run), n_tokens, ids. Extra columns of ``docs`` are ignored; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = chosen.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(files or default_tasks(spark), "id", "tie").sortWithinPartitions("id", "tie")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        run, at = TaskContext.get().partitionId(), 0
        if tokenizer not in _words:
            _words[tokenizer] = Words(tokenizer)
        words = _words[tokenizer]
        for part in slices(batches, text=1, most=BULK_BYTES, rows=BULK_ROWS):
            ids, edges = words.end_to_end(part.column(1))
            ids, sizes = np.insert(ids, edges[1:], end_id), np.diff(edges) + 1
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids, type=pa.int32()))
            yield record_batch(_FILE, [part.column(0), [run] * part.num_rows, starts, sizes, flat.cast(pa.list_(pa.field("element", pa.int32())))])

    options = {
        "compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(ROW_INDEX),
        "orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01",
    }
    ordered.mapInArrow(encoded, _FILE).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on ``id`` are pushed down to stripe statistics, row indexes and Bloom filters."""
    return spark.read.schema(_FILE).orc(path)


def token_digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of the files: the id, start (ids of all rows before it), n_tokens, ids_crc32 (little-endian words)."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column(4)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield record_batch(_DIGEST, [*part.columns[:4], sums])

    rows = read_tokens(spark, path)
    # one row per run, as many as there are files
    totals = rows.groupBy("run").agg(F.sum("n_tokens").alias("n")).orderBy("run").collect()
    starts, before = [], 0
    for row in totals:
        starts.append((row["run"], before))
        before += row["n"]
    known = F.broadcast(spark.createDataFrame(starts, "run int, before long"))
    return rows.mapInArrow(digested, _DIGEST).join(known, "run").select(
        F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
