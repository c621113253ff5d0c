"""Phrase collocations from sorted count streams.

1. ``windows``: every word position gives one record, the language and the up to LONGEST words of its piece that start there. Tasks
   write them as sorted runs of about HELD records, in which equal ones are one record with a count.
2. ``phrase_counts``: the records are sorted in prefix order over all tasks. There the occurrences of every phrase, of any length,
   stand in a row, so one scan sums them all: a phrase's count is the length of its run. Runs that touch the edge of a batch are
   sent on as partial sums; of the others, only phrases that occur often enough.
3. ``lockstep``: the counted phrases are kept in two more streams, in prefix order and in suffix order (words reversed). In the
   first a phrase follows its left parts and precedes its extensions to the right, in the second its right parts and extensions
   to the left. One scan each, with a stack of the phrases that are still open, merges the counts of parts and of extensions
   in; nothing is looked up in a hash table. Streams are cut into tasks at any row: a part whose row is in an earlier task is filled in
   from the stream afterwards, at most LONGEST - 1 parts a task.
4. Scores are decimals, as products may pass 64 bits; the first rows of each language come from salted shares first.

A part or an extension that counts occurs as often as the phrase needs to, so streams of frequent phrases hold all that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import arrow_bytes, record_batch, size_tasks, slices, stored

#: Words of the longest phrase.
LONGEST = 4
#: Occurrences a phrase needs.
LEAST = 30
#: A phrase is dropped if a longer one has at least this many per cent of its occurrences.
COVERED = 80
TOP = 2_000
SCALE = 2_000_000
NO_LANG = "und"
#: Window records that are combined at a time, and bytes of a piece that are split into words at a time.
HELD = 1_000_000
PIECE_BYTES = 4_000_000
#: Bytes of window records, and rows of phrases, that a task sorts.
SORT_BYTES = 48_000_000
SORT_ROWS = 500_000
#: Shares a language is ranked in before its first rows are ranked together.
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = bytes.maketrans(_BREAKS + _UPPER + b"\t", b"\n" * len(_BREAKS) + _UPPER.lower() + b" ")

#: How characters that separate are written in the name of a language.
_WRITTEN = (("%", "%25"), (" ", "%20"), ("\n", "%0A"))
_WINDOW = T.StructType().add("record", "string").add("n", "long")
_RUN = T.StructType().add("run", "string").add("words", "integer").add("n", "long")


def _word_runs(text: bytes, longest: int) -> Iterator[tuple[list[bytes], bool]]:
    """The words of each piece; of a very long piece in parts that overlap by longest - 1 words. True for the last part."""
    for piece in text.translate(_TABLE).split(b"\n"):
        at, carried = 0, []
        while len(piece) - at > PIECE_BYTES:
            cut = piece.find(b" ", at + PIECE_BYTES)
            if cut < 0:
                break
            words = carried + piece[at:cut].split()
            yield words, False
            at, carried = cut, words[max(0, len(words) - longest + 1) :]
        words = carried + piece[at:].split()
        if words:
            yield words, True


def text_windows(text: bytes, longest: int = LONGEST) -> Iterator[list[bytes]]:
    """For every word the up to ``longest`` words that start there in its piece, each followed by a blank; in lists of some size."""
    for words, ended in _word_runs(text, longest):
        for at in range(0, len(words), HELD):
            part = words[at : at + HELD + longest - 1]
            full = [part[k:] for k in range(longest)]
            yield list(map(b" ".join, zip(*full, repeat(b""))))
        if ended:
            yield [b" ".join([*words[i:], b""]) for i in range(max(0, len(words) - longest + 1), len(words))]


def windows(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(record, n): language, a line end and the words of a window, counted within each sorted run.

    Blanks and line ends of a language's name are written as %20 and %0A, so that records split without doubt.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for part in slices(batches, text=1):
            for lang, text in zip(part.column(0).to_pylist(), arrow_bytes(part.column(1))):
                for found in text_windows(text or b"", longest):
                    held.setdefault(lang, []).extend(found)
                    size += len(found)
                    if size > HELD:
                        yield from _run(held)
                        held, size = {}, 0
        yield from _run(held)

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG))
    for plain, written in _WRITTEN:
        lang = F.replace(lang, F.lit(plain), F.lit(written))
    return docs.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(cut, _WINDOW)


def _run(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
    for lang in sorted(held):
        counted = pc.value_counts(pa.array(held[lang], type=pa.binary()).cast(pa.string()))
        counted = counted.take(pc.sort_indices(counted.field(0)))
        yield record_batch(_WINDOW, [pc.binary_join_element_wise(f"{lang}\n", counted.field(0), ""), counted.field(1)])


def _language(column: str) -> Column:
    lang = F.substring_index(column, "\n", 1)
    for plain, written in reversed(_WRITTEN):
        lang = F.replace(lang, F.lit(written), F.lit(plain))
    return lang


def phrase_counts(records: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to ``longest`` words with at least ``least`` occurrences.

    The empty phrase of no words stands for all word occurrences of its language.
    """
    n_bytes = records.agg(F.sum(F.octet_length("record") + 16)).first()[0] or 0
    stream = records.repartitionByRange(size_tasks(n_bytes, SORT_BYTES), "record").sortWithinPartitions("record")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _runs(batch, least, longest)

    counted = stream.mapInArrow(summed, _RUN).groupBy("run", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))
    return counted.select(_language("run").alias("lang"), F.substring_index("run", "\n", -1).alias("phrase"), "words", "n")


def _runs(batch: pa.RecordBatch, least: int, longest: int) -> pa.RecordBatch:
    """The runs of equal first words in a batch of the sorted stream: those that are frequent, and those at its edges."""
    rows = batch.num_rows
    lists = pc.split_pattern(batch.column(0), " ")
    offsets = lists.offsets.to_numpy()
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    sizes = np.diff(offsets) - 1  # the blank at the end gives one empty word
    sums = np.append(0, np.cumsum(batch.column(1).to_numpy()))
    names = pc.list_element(pc.split_pattern(batch.column(0), "\n", max_splits=1), 0).dictionary_encode()
    total = np.zeros(len(names.dictionary), dtype=np.int64)
    np.add.at(total, names.indices.to_numpy(), np.diff(sums))
    out: list[list] = [[f"{name}\n" for name in names.dictionary.to_pylist()], [0] * len(total), total.tolist()]
    fresh = np.arange(rows) == 0
    for k in range(longest):
        # the first word of a record has its language before it
        word = np.where(sizes > k, codes[np.minimum(offsets[:-1] + k, len(codes) - 1)], -1)
        fresh[1:] |= word[1:] != word[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], rows)
        count = sums[last] - sums[first]
        kept = np.flatnonzero((sizes[first] > k) & ((count >= least) | (first == 0) | (last == rows)))
        out[0] += [" ".join(w.split(" ", k + 1)[: k + 1]) for w in batch.column(0).take(pa.array(first[kept])).to_pylist()]
        out[1] += [k + 1] * len(kept)
        out[2] += count[kept].tolist()
    return record_batch(_RUN, out)


def lockstep(phrases: DataFrame, reverse: bool, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n, p1 ..., extended): counts of the phrase's first (with ``reverse`` last) 1, 2, ... words, and of its most
    frequent extension by one word at the other end.

    A phrase can have several rows, each with what one task of the stream knows; all but one have a null ``n``.
    """
    schema = T.StructType().add("lang", "string").add("phrase", "string").add("words", "integer").add("n", "long")
    for k in range(1, longest):
        schema = schema.add(f"p{k}", "long")
    schema = schema.add("extended", "long")
    words = F.split("phrase", " ")
    key = F.concat(F.array_join(F.reverse(words), " ") if reverse else F.col("phrase"), F.lit(" "))
    stream = phrases.select("lang", key.alias("key"), "words", "n")
    stream = stream.repartitionByRange(size_tasks(phrases.count(), SORT_ROWS), "lang", "key").sortWithinPartitions("lang", "key")

    def told(key: str) -> str:
        return " ".join(reversed(key[:-1].split(" "))) if reverse else key[:-1]

    def row(opened: list) -> tuple:
        lang, key, words, n, parts, extended = opened
        return (lang, told(key), words, n, *parts, *[None] * (longest - 1 - len(parts)), extended)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        before: dict[tuple[str, str], int] = {}  # extensions of phrases of an earlier task: at most longest - 1 of them
        for batch in batches:
            out = []
            for lang, key, words, n in zip(*(c.to_pylist() for c in batch.columns)):
                while stack and not (stack[-1][0] == lang and key.startswith(stack[-1][1])):
                    out.append(row(stack.pop()))
                parts: list[int | None] = [None] * (words - 1)
                for opened in stack:
                    parts[opened[2] - 1] = opened[3]
                if stack and stack[-1][2] == words - 1:
                    stack[-1][5] = max(stack[-1][5] or 0, n)
                elif words > 1:
                    parent = key[: key.rstrip(" ").rindex(" ") + 1]
                    before[lang, parent] = max(before.get((lang, parent), 0), n)
                stack.append([lang, key, words, n, parts, None])
            if out:
                yield record_batch(schema, [list(c) for c in zip(*out)])
        out = [row(opened) for opened in stack]
        out += [(lang, told(key), key.count(" "), None, *[None] * (longest - 1), n) for (lang, key), n in before.items()]
        if out:
            yield record_batch(schema, [list(c) for c in zip(*out)])

    return stream.mapInArrow(merged, schema)


def _filled(rows: DataFrame, phrases: DataFrame, reverse: bool, longest: int) -> DataFrame:
    """``rows`` of ``lockstep`` with the parts whose rows were in earlier tasks."""
    side = -1 if reverse else 1
    wanted = {k: F.when(F.col("n").isNotNull() & (F.col("words") > k) & F.col(f"p{k}").isNull(), F.substring_index("phrase", " ", side * k)) for k in range(1, longest)}
    missing = rows.select("lang", F.explode(F.array_compact(F.array(*wanted.values()))).alias("phrase")).distinct()
    # at most longest - 1 rows a task of the stream
    edges = stored(missing.join(phrases.select("lang", "phrase", "n"), ["lang", "phrase"]), "collocation-edges")
    if edges.isEmpty():
        return rows
    for k, part in wanted.items():
        known = F.broadcast(edges.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n")))
        rows = rows.withColumn("_part", part)
        joined = rows.join(known, (rows["lang"] == known["_lang"]) & (rows["_part"] == known["_phrase"]), "left")
        rows = joined.withColumn(f"p{k}", F.coalesce(f"p{k}", "_n")).drop("_lang", "_phrase", "_n", "_part")
    return rows


def _wide(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, covered: int = COVERED, top: int = TOP,
    longest: int = LONGEST,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; ``.,;:!?`` and line ends cut a text into pieces, blanks and tabs a piece into words. A null language is
    ``und``, and counts together with a language of that name; a null or empty text has no words. Every row counts, repeated ones too.
    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words of the language. Equal
    scores go by ``a``, then by the phrase's bytes. Extra columns are ignored; an empty table gives an empty table.
    """
    # sorted strings are stored as their differences
    written = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
    records = stored(windows(docs, lang_col, text_col, longest), "collocation-windows", **written)
    counted = stored(phrase_counts(records, least, longest), "collocation-phrases")
    phrases = counted.where("words > 0")
    sides = []
    for reverse, name in ((False, "l"), (True, "r")):
        rows = _filled(stored(lockstep(phrases, reverse, longest), f"collocation-{name}"), phrases, reverse, longest)
        parts = {f"{side}{k}": F.col(f"p{k}") if side == name else F.lit(None).cast("long") for side in "lr" for k in range(1, longest)}
        sides.append(rows.where("words > 1").select("lang", "phrase", "words", "n", "extended", *[c.alias(x) for x, c in parts.items()]))
    numbers = ["n", "extended", *[f"{side}{k}" for side in "lr" for k in range(1, longest)]]
    known = sides[0].unionByName(sides[1]).groupBy("lang", "phrase", "words").agg(*[F.max(c).alias(c) for c in numbers])
    known = known.withColumnRenamed("n", "a").where(~(_wide(F.col("extended")) * 100 >= _wide(F.col("a")) * covered) | F.col("extended").isNull())
    cuts = []
    for n in range(2, longest + 1):
        for k in range(1, n):
            score = F.expr(f"CAST(CAST(a AS DECIMAL(20,0)) * {SCALE}BD AS DECIMAL(38,0)) div (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{n - k} AS DECIMAL(20,0)))")
            cut = F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{n - k}").alias("r"))
            cuts.append(F.when(F.col("words") == n, cut))
    scored = known.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counted.where("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
