"""Benchmark decontamination with a BM25 inverted index of the test items and block-max WAND.

The index covers the test items: postings per term in item order, cut into blocks of BLOCK items with their largest
impact. Impacts are BM25 weights divided by the item's score against itself, so a score of 1 means that all of an item
was found and one threshold fits items of any length. Every document is read as passages that overlap by half and
are twice as long as the longest item: whatever item it holds lies whole in one of them. Each passage is a
query; all items at or above the threshold are retrieved. Passages in which no item can reach the threshold, even if all
its common terms were there, are ruled out at once by sums over all positions; the rest go through block-max WAND. What is retrieved is then verified: shingles of
the item's question and of its answer must both occur in the passage.

Items are indexed INDEX_ITEMS at a time (a bounded broadcast); a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import column, every_column, record_batch, slices

INDEX_ITEMS = 20_000
BLOCK = 64
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be verified.
RETRIEVE = 0.5
#: Share of the question's and of the answer's shingles that a leak must contain.
OVERLAP = 0.5
#: Words per shingle; short answers take fewer.
SHINGLE = 5
#: A term is selective if at most this many items, or a hundredth of them, have it.
SELECTIVE = 8
#: Punctuation that does not count at the ends of words.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all words, dictionary-coded, and the offsets of each text's words); split at ASCII blanks, null as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()


def folded(words: pa.Array) -> pa.Array:
    """Words in lower case without punctuation at their ends."""
    return pc.utf8_trim(pc.utf8_lower(words.cast(pa.large_string())), characters=EDGES)


def fold_words(text: str | None) -> list[str]:
    codes, _ = words_of(pa.array([text], type=pa.large_string()))
    names = folded(codes.dictionary).to_pylist()
    return [w for w in (names[i] for i in codes.indices.to_pylist()) if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str], int]:
    """The words of a test item up to its answer, those of the answer, and how many words a shingle of the answer has.

    The answer is the last sentence, or a quarter of an item of one sentence (at least SHINGLE words), with as many words before it
    that every shingle holds a word of it: the question alone never gives one. Shingles have at most half of its words,
    so that one changed word leaves half of them. An item of at most SHINGLE words is all answer and one shingle.
    """
    sentences = [fold_words(s) for s in (text or "").replace("!", ".").replace("?", ".").split(".")]
    words = [w for s in sentences for w in s]
    last = len(next((s for s in reversed(sentences) if s), []))
    if len(words) <= SHINGLE:
        return [], words, len(words)
    if last == len(words):
        last = max(SHINGLE, last // 4)
    width = min(SHINGLE, max(2, last // 2))
    cut = max(0, len(words) - last - width + 1)
    return words[:cut], words[cut:], width


def contained(part: list[int], passage: set[tuple[int, ...]], width: int) -> float:
    """The share of the part's shingles in the passage; an empty part is contained."""
    shingles = [tuple(part[i : i + width]) for i in range(len(part) - width + 1)]
    return sum(s in passage for s in shingles) / len(shingles) if shingles else 1.0


@dataclass
class Index:
    """Terms are numbered; postings of term t are rows first[t] to first[t + 1] of items and impacts, items ascending."""

    terms: pa.Array
    first: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    best: np.ndarray  # largest impact of each term
    item_ids: list
    questions: list[list[int]]
    answers: list[list[int]]
    passage: int  # words in a passage
    selective: np.ndarray  # whether few items have the term
    granted: np.ndarray  # per item the impact of all its other terms
    open: bool  # whether those alone can reach the threshold
    widths: list[int]  # words per shingle of the answer

    def blocks(self, term: int) -> dict[int, float]:
        """Block number -> largest impact of the term in it."""
        a, b = self.first[term], self.first[term + 1]
        out: dict[int, float] = {}
        for item, impact in zip((self.items[a:b] // BLOCK).tolist(), self.impacts[a:b].tolist()):
            out[item] = max(out.get(item, 0.0), impact)
        return out


def build_index(rows: list[tuple[object, str | None]], threshold: float = RETRIEVE) -> Index | None:
    """The index of (item id, text) rows; None if no item has a word. Items without words cannot leak and are left out."""
    parts = [(item, *question_and_answer(text)) for item, text in rows]
    parts = sorted((p for p in parts if p[2]), key=lambda p: (p[0] is None, str(p[0]).zfill(20), p[1], p[2]))
    if not parts:
        return None
    bags = [Counter(q + a) for _, q, a, _ in parts]
    lengths = [sum(bag.values()) for bag in bags]
    mean = sum(lengths) / len(bags)
    df = Counter(t for bag in bags for t in bag)
    names = sorted(df)
    number = {t: i for i, t in enumerate(names)}
    idf = {t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) for t in names}
    postings: list[list[tuple[int, float]]] = [[] for _ in names]
    for item, (bag, length) in enumerate(zip(bags, lengths)):
        weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for t, n in bag.items()}
        own = sum(weight.values())
        for t, x in weight.items():
            postings[number[t]].append((item, x / own))
    sizes = np.array([len(p) for p in postings])
    flat = [x for p in postings for x in p]
    coded = lambda words: [number[w] for w in words]
    first, items, impacts = np.concatenate([[0], np.cumsum(sizes)]), np.array([i for i, _ in flat]), np.array([x for _, x in flat])
    selective = sizes <= max(SELECTIVE, len(bags) // 100)
    common = ~np.repeat(selective, sizes)
    granted = np.bincount(items[common], weights=impacts[common], minlength=len(bags))
    return Index(
        pa.array(names, type=pa.large_string()), first, items, impacts, np.array([max(x for _, x in p) for p in postings]),
        [p[0] for p in parts], [coded(p[1]) for p in parts], [coded(p[2]) for p in parts], 2 * max(lengths),
        selective, granted, bool((granted >= threshold).any()), [p[3] for p in parts],
    )


class Retriever:
    """Block-max WAND over an index with a fixed threshold; all items at or above it are returned."""

    def __init__(self, index: Index, threshold: float):
        self.index, self.threshold = index, threshold - 1e-9
        self.block_max: dict[int, dict[int, float]] = {}

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) for a query of different terms."""
        ix = self.index
        cursors = []  # [current item, position, end, term]
        for t in terms:
            a, b = int(ix.first[t]), int(ix.first[t + 1])
            cursors.append([int(ix.items[a]), a, b, t])
            if t not in self.block_max:
                self.block_max[t] = ix.blocks(t)
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for place, c in enumerate(cursors):
                total += ix.best[c[3]]
                if total >= self.threshold:
                    pivot = place
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            bound = sum(self.block_max[c[3]].get(block, 0.0) for c in cursors[: pivot + 1])
            if bound < self.threshold:
                # nothing of these terms in this block can reach the threshold: on to the next block or term
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(target, item + 1))
            elif cursors[0][0] == item:
                score = sum(float(ix.impacts[c[1]]) for c in cursors[: pivot + 1])
                if score >= self.threshold:
                    found.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot, item)
            cursors = [c for c in cursors if c[1] < c[2]]
        return found

    def _advance(self, cursors: list[list[int]], count: int, target: int) -> None:
        """The first ``count`` cursors move to their first item at or after ``target``."""
        items = self.index.items
        for c in cursors[:count]:
            if c[0] < target:
                c[1] += int(np.searchsorted(items[c[1] : c[2]], target))
                if c[1] < c[2]:
                    c[0] = int(items[c[1]])


def leaks_in(texts: pa.Array, index: Index, retriever: Retriever, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item number, score, question overlap, answer overlap) of verified leaks, the best passage of each pair."""
    codes, offsets = words_of(texts)
    names = folded(codes.dictionary)
    # words without letters or digits are no words here, as in the items
    term_of = pc.fill_null(pc.index_in(names, value_set=index.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term_of[pc.equal(names, "").to_numpy(zero_copy_only=False)] = -2
    terms = term_of[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, dtype=np.int64)
    real = terms != -2
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[real]
    terms = terms[real]
    starts = np.searchsorted(row_of, np.arange(len(offsets)))
    size, step = index.passage, index.passage // 2
    lengths = np.diff(starts)
    halves, passages = -(-lengths // step), np.maximum(1, -(-(lengths - size) // step) + 1)
    owner = np.repeat(np.arange(len(lengths)), passages)
    first = np.cumsum(passages) - passages
    begin = starts[owner] + (np.arange(len(owner)) - first[owner]) * step
    end = np.minimum(begin + size, starts[owner + 1])
    possible = _possible(terms, row_of, starts, halves, passages, first, step, index, retriever.threshold)
    possible = _once_each(possible, terms, begin, end, index, retriever.threshold)
    if index.open:
        # items of common words alone: any passage whose terms add up may hold one
        weight = np.concatenate([[0.0], np.cumsum(np.where(terms >= 0, index.best[terms], 0.0))])
        possible = np.union1d(possible, np.flatnonzero(weight[end] - weight[begin] >= retriever.threshold))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in possible.tolist():
        passage = terms[begin[p] : end[p]]
        query = np.unique(passage[passage >= 0])
        if index.best[query].sum() < retriever.threshold:
            continue
        coded, sets = passage.tolist(), {}
        for item, score in retriever.search(query.tolist()):
            shares = []
            question, answer = index.questions[item], index.answers[item]
            for part, width in ((question, min(SHINGLE, len(question))), (answer, index.widths[item])):
                if width not in sets:
                    sets[width] = {tuple(coded[i : i + width]) for i in range(len(coded) - width + 1)}
                shares.append(contained(part, sets[width], width) if width else 1.0)
            if min(shares) >= overlap:
                key = (int(owner[p]), item)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (min(score, 1.0), *shares))
    for (row, item), found in sorted(best.items()):
        yield row, item, *found


def _possible(
    terms: np.ndarray, row_of: np.ndarray, starts: np.ndarray, halves: np.ndarray, passages: np.ndarray, first: np.ndarray,
    step: int, index: Index, threshold: float,
) -> np.ndarray:
    """The passages in which some item's selective terms, with all its common ones granted, add up to the threshold.

    An upper bound for every item, so no match is lost: impacts are added up per half passage and item, repeats included.
    """
    at = np.flatnonzero((terms >= 0) & index.selective[terms])
    n_items = len(index.item_ids)
    per = np.diff(index.first)[terms[at]]
    posting = np.repeat(index.first[terms[at]] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    row = np.repeat(row_of[at], per)
    half = np.repeat((at - starts[row_of[at]]) // step, per)
    items, impacts = index.items[posting], index.impacts[posting]
    keys, sums = [], []
    for place in (half, half - 1):  # a half belongs to the passage it begins and to the one before
        inside = (place >= 0) & (place < passages[row])
        keys.append((first[row[inside]] + place[inside]) * n_items + items[inside])
        sums.append(impacts[inside])
    return _reaching(np.concatenate(keys), np.concatenate(sums), index, threshold)


def _reaching(keys: np.ndarray, impacts: np.ndarray, index: Index, threshold: float) -> np.ndarray:
    """The passages of (passage x items + item) keys whose impacts and granted terms reach the threshold for an item."""
    n_items = len(index.item_ids)
    pairs, which = np.unique(keys, return_inverse=True)
    bound = np.bincount(which, weights=impacts, minlength=len(pairs)) + index.granted[pairs % n_items]
    return np.unique(pairs[bound >= threshold] // n_items)


def _once_each(
    possible: np.ndarray, terms: np.ndarray, begin: np.ndarray, end: np.ndarray, index: Index, threshold: float
) -> np.ndarray:
    """The same bound for the passages left, with each term counted once."""
    sizes = end[possible] - begin[possible]
    at = np.repeat(begin[possible] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    passage = np.repeat(possible, sizes)
    use = (terms[at] >= 0) & index.selective[terms[at]]
    different = np.unique(passage[use] * len(index.best) + terms[at[use]])
    passage, term = different // len(index.best), different % len(index.best)
    per = np.diff(index.first)[term]
    posting = np.repeat(index.first[term] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return _reaching(np.repeat(passage, per) * len(index.item_ids) + index.items[posting], index.impacts[posting], index, threshold)


def index_blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int = INDEX_ITEMS, threshold: float = RETRIEVE) -> Iterator[Index]:
    """Indexes of at most ``size`` items each, in item order; the driver holds one of them at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    block: list[tuple[object, str | None]] = []
    for row in items.orderBy("item", "text").toLocalIterator():
        block.append((row["item"], row["text"]))
        if len(block) == size:
            if index := build_index(block, threshold):
                yield index
            block = []
    if index := build_index(block, threshold):
        yield index


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", retrieve: float = RETRIEVE, overlap: float = OVERLAP,
) -> DataFrame:
    """One row per document row and test item that it leaks: the id column, item_id, score, question_overlap, answer_overlap.

    Words are compared in lower case without punctuation at their ends. Null, empty and wordless texts and items leak
    nothing. Repeated rows give repeated rows, equal items are found each. Extra columns are ignored; an empty table on
    either side gives no rows. Whole texts are read, whatever their length.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType(
        [chosen.schema["id"], T.StructField("item_id", benchmark.schema[item_col].dataType)]
        + [T.StructField(name, T.DoubleType()) for name in ("score", "question_overlap", "answer_overlap")]
    )
    found = None
    for index in index_blocks(benchmark, item_col, item_text_col, threshold=retrieve):
        part = chosen.mapInArrow(_finder(docs, index, retrieve, overlap, schema), schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col) if id_col != "id" else found


def _finder(docs: DataFrame, index: Index, retrieve: float, overlap: float, schema: T.StructType):
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most INDEX_ITEMS items

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        retriever = Retriever(own, retrieve)
        for part in slices(batches, text=1):
            rows = list(leaks_in(part.column(1), own, retriever, overlap))
            ids = part.column(0).take(pa.array([r[0] for r in rows], type=pa.int64()))
            yield record_batch(schema, [ids, [own.item_ids[r[1]] for r in rows], *([r[i] for r in rows] for i in (2, 3, 4))])

    return find


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no test item, unchanged; filtered where they are read, without a shuffle."""
    # one struct goes through the workers, so that columns may have any name
    row = F.struct(*every_column(docs)).alias("row")
    out = docs.select(row, column(text_col).cast("string").alias("text"))
    for index in index_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.mapInArrow(_dropper(shared, 1), out.schema)
    return out.select("row.*")


def _dropper(shared, position: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        retriever = Retriever(own, RETRIEVE)
        for part in slices(batches, text=position):
            leaking = {row for row, *_ in leaks_in(part.column(position), own, retriever, OVERLAP)}
            yield part.filter(pa.array([i not in leaking for i in range(part.num_rows)], type=pa.bool_()))

    return drop
