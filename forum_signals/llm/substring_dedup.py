"""Substring dedup with compressed FM-indexes per shard.

A window is WINDOW consecutive words. Every word covered by a window that also starts in a document with a smaller id is removed;
windows are judged on the input.

Texts are stored once, in blocks of about BLOCK_BYTES that are bucketed by block, and are not moved again: what the steps tell
each other travels as packed arrays per block.

1. ``requests``: of a window's SEED_WORDS-word seeds the one with the least hash is its anchor; a run of windows with one anchor
   is a segment. Equal windows have equal anchors. Each block names its anchors.
2. ``answers``: owner tasks, each with a range of anchors, tell every block which of its anchors occur in other rows, too; only
   those can hold a repeated window.
3. ``entries``: each block cuts out the different segments of those anchors and sends them to shards by anchor. Copies in a
   block are one entry with their least and greatest id. Anchors with over HOT_SEGMENTS segments (a common line in ever new
   surroundings, or copies by the thousand) are entered window by window and go to shards by the window's hash,
   so no shard gets more than its share.
4. ``search_shard``: a shard builds an FM-index (suffix order, BWT, wavelet matrix) of its different entries, streams all of
   them against it by backward search, and takes from each suffix interval of WINDOW words the least and the greatest id.
   Windows found in two documents go back to the blocks that asked.
5. Each block looks its windows up, merges the matches to intervals and writes the kept words' digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import arrow_bytes, default_tasks, record_batch, size_tasks, slices
from forum_signals.llm.fm_index import FMIndex
from forum_signals.session import shared_dir

WINDOW = 13
SEED_WORDS = 5
HOT_SEGMENTS = 1_000
SHARD_WORDS = 400_000
BLOCK_BYTES = 24_000_000
#: Anchors an owner task holds.
OWNED_ANCHORS = 3_000_000
#: Null ids are judged as the largest id.
NULL_ID = (1 << 63) - 1
#: Anchors are 48-bit numbers: a chance meeting of two costs a little work, and no error.
ANCHOR_BITS = 48

_BLOCK = T.StructType().add("block", "long").add("id", "long").add("text", "string")
_ASK = T.StructType().add("owner", "integer").add("block", "long").add("packed", "binary")
_ANSWER = T.StructType().add("block", "long").add("packed", "binary")
_ENTRY = (
    T.StructType().add("shard", "integer").add("block", "long").add("least", "long").add("greatest", "long").add("words", "binary")
)
_KEPT = (
    T.StructType().add("id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    .add("removed", T.ArrayType(T.StructType().add("first", "integer").add("last", "integer")))
)


class Words:
    """The words of some texts, their hashes, and the windows, anchors and segments over them."""

    def __init__(self, column: pa.Array, window: int, seed: int):
        self.column = column
        lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        self.counts = np.diff(offsets)
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        if not real.all():  # blanks at the ends of a text give empty pieces
            rows = np.searchsorted(offsets, np.flatnonzero(~real), side="right") - 1
            self.counts = self.counts - np.bincount(rows, minlength=len(self.counts))
            words = words.filter(pa.array(real))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.window, n = window, len(words)
        codes = words.dictionary_encode()
        digest = xxhash.xxh64_intdigest
        distinct = np.fromiter(map(digest, codes.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(codes.dictionary))
        self.hashes = distinct[codes.indices.to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.uint64)
        self.total = max(0, n - window + 1)
        self.doc_of = np.repeat(np.arange(len(column)), self.counts)
        row = self.doc_of[: self.total]
        self.valid = np.arange(self.total) + window <= self.ends[row]
        none = np.zeros(0, dtype=np.int64)
        self.anchor, self.first, self.windows, self.row = none, none, none, none
        if not self.total:
            return
        seeds = _mixed(_rolled(self.hashes, seed))
        # the place within the window takes the lowest four bits: one minimum finds hash and (leftmost) place
        seeds &= ~np.uint64(15)
        least = seeds[: self.total].copy()
        for i in range(1, window - seed + 1):
            np.minimum(least, seeds[i : i + self.total] | np.uint64(i), out=least)
        place = (least & np.uint64(15)).astype(np.int64) + np.arange(self.total)
        fresh = np.ones(self.total, dtype=bool)
        fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(fresh & self.valid)
        # a segment ends where the next one begins or the windows of its text end
        stop = np.minimum(np.append(at[1:], self.total), self.ends[row[at]] - window + 1)
        self.anchor, self.first, self.windows, self.row = least[at] >> np.uint64(64 - ANCHOR_BITS), at, stop - at, row[at]

    def window_hashes(self) -> np.ndarray:
        """A hash of every run of WINDOW words (those across texts are not valid ones)."""
        return _mixed(_rolled(self.hashes, self.window)) if self.total else np.zeros(0, np.uint64)

    def segment_hashes(self) -> np.ndarray:
        """A hash of each segment's words: equal segments of equal anchors have equal hashes."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(self.hashes), _BASE)))
        inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(self.hashes), np.uint64(pow(int(_BASE), -1, 1 << 64)))))
        sums = np.append(np.uint64(0), np.cumsum(self.hashes * power[:-1]))
        last = self.first + self.windows + self.window - 1
        return _mixed((sums[last] - sums[self.first]) * inverse[self.first])

    @cached_property
    def lists(self) -> list[list[bytes]]:
        """The words of each text, for the steps that write them out."""
        return [(text or b"").split() for text in arrow_bytes(self.column)]

    def span(self, first: int, length: int) -> bytes:
        row = int(self.doc_of[first])
        at = first - int(self.starts[row])
        return b" ".join(self.lists[row][at : at + length])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * _BASE + hashes[i : i + len(out)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as their steps, six byte planes (the high ones are almost all zero)."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel().astype(np.uint64))


def _store_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, id, text), stored in the shared folder in buckets of blocks."""
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 20, 0
        for part in slices(batches, text=1):
            held += part.nbytes
            yield record_batch(_BLOCK, [[block] * part.num_rows, *part.columns])
            if held >= block_bytes:
                block, held = block + 1, 0

    spark = docs.sparkSession
    name = f"llm_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/forum_signals/{name}"
    writer = chosen.mapInArrow(numbered, _BLOCK).write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(default_tasks(spark), "block").saveAsTable(name)
    return spark.table(name)


def _requests(blocks: DataFrame, owners: int, window: int, seed: int) -> DataFrame:
    """(owner, block, packed): a block's different anchors, whether several rows have one, and how many segments."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of, row = None, 0
        for part in slices(batches, text=2):
            found = Words(part.column(2), window, seed)
            block = np.array(part.column(0).to_pylist(), dtype=np.int64)[found.row]
            for one in np.unique(block).tolist():
                if of is not None and one != of:
                    yield _ask(of, held, owners)
                    held = []
                of = one
                mine = block == one
                held.append(np.stack([found.anchor[mine], (row + found.row[mine]).astype(np.uint64), found.segment_hashes()[mine]]))
            row += part.num_rows
        if held:
            yield _ask(of, held, owners)

    return blocks.mapInArrow(asked, _ASK)


def _ask(block: int, held: list[np.ndarray], owners: int) -> pa.RecordBatch:
    anchor, row, segment = np.concatenate(held, axis=1)
    order = np.lexsort((segment, anchor))
    anchor, row, segment = anchor[order], row[order], segment[order]
    fresh = np.append(True, anchor[1:] != anchor[:-1])
    first = np.flatnonzero(fresh)
    several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first)
    kinds = np.add.reduceat((fresh | np.append(True, segment[1:] != segment[:-1])).astype(np.int64), first)
    anchor = anchor[first]
    owner = _owner(anchor, owners)
    edges = np.searchsorted(owner, np.arange(owners + 1))
    rows = []
    for o, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if a < b:
            flags = (np.minimum(kinds[a:b], 127).astype(np.uint8) << 1) | several[a:b]
            rows.append((o, block, _pack_sorted(anchor[a:b]) + flags.tobytes()))
    return record_batch(_ASK, [list(c) for c in zip(*rows)])


def _owner(anchor: np.ndarray, owners: int) -> np.ndarray:
    """The range of anchors a number is in."""
    return ((anchor >> np.uint64(16)) * np.uint64(owners) >> np.uint64(ANCHOR_BITS - 16)).astype(np.int64)


def _answers(requests: DataFrame, hot_segments: int) -> DataFrame:
    """(block, packed): the block's anchors that other rows have, too, each with a mark if it is a hot one."""

    def answered(asked: pa.Table) -> pa.Table:
        blocks = asked.column("block").to_numpy()
        numbers, flags = [], []
        for packed in asked.column("packed").to_pylist():
            n = len(packed) // 7
            numbers.append(_unpack_sorted(packed[: 6 * n]))
            flags.append(np.frombuffer(packed[6 * n :], dtype=np.uint8))
        sizes = [len(x) for x in numbers]
        anchor, flag = np.concatenate(numbers), np.concatenate(flags)
        different, which = np.unique(anchor, return_inverse=True)
        shared = np.bincount(which) > 1
        shared |= np.bincount(which, weights=flag & 1) > 0
        hot = np.bincount(which, weights=flag >> 1) > hot_segments
        rows = []
        for block, part in zip(blocks.tolist(), np.split(which, np.cumsum(sizes)[:-1])):
            mine = part[shared[part]]
            if len(mine):
                rows.append((block, _pack_sorted(different[mine]) + hot[mine].astype(np.uint8).tobytes()))
        return pa.Table.from_batches([record_batch(_ANSWER, [list(c) for c in zip(*rows)] if rows else [[], []])])

    return requests.groupBy("owner").applyInArrow(answered, _ANSWER)


def _entries(blocks: DataFrame, answers: DataFrame, shards: int, window: int, seed: int) -> DataFrame:
    """(shard, block, least, greatest, words): the different segments of shared anchors, and windows of hot ones, per block."""

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        known = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=bool)]
        for packed in told.column("packed").to_pylist():
            n = len(packed) // 7
            known[0].append(_unpack_sorted(packed[: 6 * n]))
            known[1].append(np.frombuffer(packed[6 * n :], dtype=np.uint8) > 0)
        shared, marks = np.concatenate(known[0]), np.concatenate(known[1])
        order = np.argsort(shared)
        shared, marks = shared[order], marks[order]
        found: dict[tuple[int, int], list] = {}
        for part in slices(texts.combine_chunks().to_batches(), text=2) if len(shared) else ():
            owns = np.array([NULL_ID if i is None else i for i in part.column(1).to_pylist()], dtype=np.int64)
            own = Words(part.column(2), window, seed)
            at = np.minimum(np.searchsorted(shared, own.anchor), len(shared) - 1)
            hit = shared[at] == own.anchor
            hot = hit & marks[at]
            cold = np.flatnonzero(hit & ~hot)
            _gather(found, own, owns, own.first[cold], own.windows[cold] + window - 1, own.anchor[cold], own.segment_hashes()[cold])
            many = np.flatnonzero(hot)
            per = own.windows[many]
            places = np.repeat(own.first[many] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            hashes = own.window_hashes()[places]
            _gather(found, own, owns, places, np.full(len(places), window), hashes, hashes)
        block = texts.column("block")[0].as_py() if texts.num_rows else 0
        routes = np.fromiter((r for r, _ in found), dtype=np.uint64, count=len(found))
        columns = [(_mixed(routes) % np.uint64(shards)).astype(np.int32), [block] * len(found)]
        columns += [[v[i] for v in found.values()] for i in range(3)]
        return pa.Table.from_batches([record_batch(_ENTRY, columns)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, _ENTRY)


def _gather(found: dict, own: Words, owns: np.ndarray, first, length, route, key) -> None:
    """Add spans to ``found``: (route, key) -> [least id, greatest id, words]."""
    ids = owns[own.doc_of[first]] if len(first) else owns[:0]
    for f, n, r, k, i in zip(first.tolist(), length.tolist(), route.tolist(), key.tolist(), ids.tolist()):
        entry = found.get((r, k))
        if entry is None:
            found[r, k] = [i, i, own.span(f, n)]
        else:
            entry[0], entry[1] = min(entry[0], i), max(entry[1], i)


def search_shard(spans: list[bytes], least: np.ndarray, greatest: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(entry, window hash, least id, greatest id) for every window of every entry, over all entries of the shard."""
    # equal entries of several blocks are indexed once
    different = {}
    which = np.array([different.setdefault(s, len(different)) for s in spans], dtype=np.int64)
    low_id, high_id = np.full(len(different), NULL_ID), np.full(len(different), -NULL_ID)
    np.minimum.at(low_id, which, least)
    np.maximum.at(high_id, which, greatest)
    lists = [s.split() for s in different]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    codes = pa.array([w for x in lists for w in x], type=pa.binary()).dictionary_encode()
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(lists)), sizes)
    symbols = np.zeros(n + len(lists), dtype=np.int64)
    symbols[np.arange(n) + owner] = codes.indices.to_numpy(zero_copy_only=False) + 1
    index = FMIndex(symbols, len(codes.dictionary) + 1, int(sizes.max(initial=0)))
    begins = np.cumsum(sizes + 1) - sizes - 1
    per = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(begins - (np.cumsum(per) - per), per) + np.arange(per.sum())
    low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    places = index.places()
    for at in range(0, len(starts), 100_000):
        some = starts[at : at + 100_000]
        low[at : at + 100_000], high[at : at + 100_000] = index.search(symbols[some[:, None] + np.arange(window)], places[some])
    # all occurrences of one window are one suffix interval, and those of different windows do not overlap
    holder = np.repeat(np.arange(len(lists)), sizes + 1)[index.order]
    firsts, group = np.unique(low, return_inverse=True)
    lasts = np.zeros(len(firsts), dtype=np.int64)
    lasts[group] = high
    edges = np.stack([firsts, lasts], axis=1).ravel()
    smallest = np.minimum.reduceat(np.append(low_id[holder], NULL_ID), edges)[::2][group]
    largest = np.maximum.reduceat(np.append(high_id[holder], -NULL_ID), edges)[::2][group]
    distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in codes.dictionary.to_pylist()), dtype=np.uint64, count=len(codes.dictionary))
    words = np.append(np.uint64(0), distinct)[symbols]
    hashes = _mixed(_rolled(words, window))[starts]
    # back to the entries as they came
    offset = np.cumsum(per) - per
    counts = per[which]
    back = np.repeat(offset[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.repeat(np.arange(len(spans)), counts), hashes[back], smallest[back], largest[back]


def _matches(entries: DataFrame, window: int) -> DataFrame:
    """(block, packed): hash and least id of the windows of a block that two documents have."""

    def searched(shard: pa.Table) -> pa.Table:
        blocks = shard.column("block").to_numpy()
        entry, hashes, least, greatest = search_shard(
            shard.column("words").to_pylist(), shard.column("least").to_numpy(), shard.column("greatest").to_numpy(), window
        )
        twice = least < greatest
        block, hashes, least = blocks[entry[twice]], hashes[twice], least[twice]
        order = np.lexsort((hashes, block))
        block, hashes, least = block[order], hashes[order], least[order]
        keep = np.append(True, (hashes[1:] != hashes[:-1]) | (block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
        block, hashes, least = block[keep], hashes[keep], least[keep]
        names, at = np.unique(block, return_index=True)
        rows = [
            (b, hashes[x:y].tobytes() + least[x:y].tobytes())
            for b, x, y in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(block)])
        ]
        return pa.Table.from_batches([record_batch(_ANSWER, [list(c) for c in zip(*rows)] if rows else [[], []])])

    return entries.groupBy("shard").applyInArrow(searched, _ANSWER)


def _removed(blocks: DataFrame, matches: DataFrame, window: int, seed: int) -> DataFrame:
    def removed(texts: pa.Table, told: pa.Table) -> pa.Table:
        hashes, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for packed in told.column("packed").to_pylist():
            half = len(packed) // 2
            hashes.append(np.frombuffer(packed[:half], dtype=np.uint64))
            least.append(np.frombuffer(packed[half:], dtype=np.int64))
        known, smallest = np.concatenate(hashes), np.concatenate(least)
        order = np.argsort(known, kind="stable")
        known, smallest = known[order], smallest[order]
        out = []
        for part in slices(texts.combine_chunks().to_batches(), text=2):
            ids = part.column(1).to_pylist()
            owns = np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64)
            own = Words(part.column(2), window, seed)
            gone = np.zeros(0, dtype=np.int64)
            if len(known) and own.total:
                wanted = own.window_hashes()
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                gone = np.flatnonzero((known[at] == wanted) & own.valid & (smallest[at] < owns[own.doc_of[: own.total]]))
            n = len(own.hashes)
            edges = np.bincount(gone, minlength=n + 1) - np.bincount(gone + window, minlength=n + 1)
            keep = np.cumsum(edges)[:n] == 0
            out.append(_kept_rows(own, ids, keep))
        return pa.Table.from_batches(out or [record_batch(_KEPT, [[], [], [], [], []])])

    return blocks.groupBy("block").cogroup(matches.groupBy("block")).applyInArrow(removed, _KEPT)


def _kept_rows(own: Words, ids: list, keep: np.ndarray) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], []]
    for words, a, b in zip(own.lists, own.starts.tolist(), own.ends.tolist()):
        stay = keep[a:b]
        n = b - a - int(stay.sum())
        kept = b" ".join(words if not n else [w for w, k in zip(words, stay.tolist()) if k])
        turns = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8))) if n else np.zeros(0, np.int64)
        spans = [{"first": x, "last": y - 1} for x, y in zip(turns[::2].tolist(), turns[1::2].tolist())]
        for column, value in zip(columns, (b - a, n, hashlib.sha256(kept).hexdigest(), spans)):
            column.append(value)
    return record_batch(_KEPT, [ids, *columns])


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED_WORDS,
    hot_segments: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, owned: int = OWNED_ANCHORS,
) -> DataFrame:
    """One row per input row: the id column, n_words, n_removed, kept_sha256, removed (first and last word of each interval).

    ``window`` less ``seed`` may be at most 15. Words are split at ASCII blanks and otherwise taken as they are. A null id counts as the largest; rows of
    one id never count against each other. Null and empty texts have no words; texts shorter than a window keep all. Repeated
    rows give repeated rows. Extra columns are ignored, an empty table gives an empty table. Memory in a task follows a
    block, an owner's anchors or a shard; a longer text is a block of its own.
    """
    blocks = _store_blocks(docs, id_col, text_col, block_bytes)
    n_bytes = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one anchor in five words, and a third of the words in segments that are sent on
    owners, shards = size_tasks(n_bytes // 30, owned), size_tasks(n_bytes // 6, shard_words)
    answers = _answers(_requests(blocks, owners, window, seed), hot_segments)
    matches = _matches(_entries(blocks, answers, shards, window, seed), window)
    kept = _removed(blocks, matches, window, seed)
    return kept.withColumnRenamed("id", id_col) if id_col != "id" else kept
