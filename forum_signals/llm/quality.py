"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (its lines, long lines cut at PASSAGE_BYTES bytes). Every passage is encoded by the counts of
neighbouring character classes; a small network turns it into an embedding h, gives it a gated attention weight
softmax(w . (tanh(V h) * sigmoid(U h))) within its document, and scores the weighted passage embedding. Only
documents have labels, so what a bad passage looks like is learned through the attention.

The network is fitted in numpy on the driver, on a bounded sample of labelled rows (FIT_ROWS rows in the order of a hash of
the id, and about FIT_BYTES bytes of their text, longer texts by a sample of their passages); scoring runs in the tasks that read the texts, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import arrow_bytes, id_bucket, limit_threads, record_batch, slices

FIT_ROWS = 4_000
FIT_BYTES = 16_000_000
#: Rows of either label that the sample holds at least, if there are so many.
FIT_LEAST = 64
FOLDS = 5
THRESHOLD = 0.3
PASSAGE_BYTES = 256
#: Of the line ends in one such stretch of a text only the first one ends a passage, so that short lines are read together.
LINE_BYTES = 64
#: Bytes of text whose passages are held at a time; a longer text is read in blocks of so many bytes.
BLOCK_BYTES = 1_000_000
WIDTH = 16
EPOCHS = 60
BATCH = 64
RATE = 0.01
SEED = 20

#: Character classes of a byte; what is not listed is class 0 (control characters).
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-", b"!",
    b"()[]{}<>", b"|/\\_=+~^`", b"#$%&*@", bytes(range(128, 192)), bytes(range(192, 256)),
)
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 2
_CLASS_OF = np.zeros(256, dtype=np.int64)
for _number, _members in enumerate(CLASSES, 1):
    _CLASS_OF[list(_members)] = _number


def encode_passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, bag starts): one row per passage, and the first passage of each text.

    Null and empty texts are one passage without characters. Every byte of every text counts.
    """
    raw = [text or b"" for text in texts]
    lengths = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    firsts = np.cumsum(lengths) - lengths
    doc_of = np.repeat(np.arange(len(raw)), lengths)
    # a passage begins at a text's start, after the first line end of a stretch, and PASSAGE_BYTES after the last beginning
    begins = np.zeros(len(data), dtype=bool)
    begins[firsts[lengths > 0]] = True
    after = np.flatnonzero(data[:-1] == 10) + 1 if len(data) else np.zeros(0, dtype=np.int64)
    stretch = (after - firsts[doc_of[after]]) // LINE_BYTES
    begins[after[np.append(True, (stretch[1:] != stretch[:-1]) | (doc_of[after[1:]] != doc_of[after[:-1]]))[: len(after)]]] = True
    at = np.flatnonzero(begins)
    since = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    begins |= since % PASSAGE_BYTES == 0
    passage = np.cumsum(begins) - 1
    counts_of = np.bincount(doc_of[begins], minlength=len(raw)) if len(data) else np.zeros(len(raw), dtype=np.int64)
    # texts without bytes get a passage of their own
    n_passages = np.maximum(counts_of, 1)
    starts = np.cumsum(n_passages) - n_passages
    shift = np.cumsum(lengths == 0)
    row = passage + shift[doc_of] if len(data) else passage
    total = int(n_passages.sum())
    features = np.zeros((total, N_FEATURES), dtype=np.float32)
    if len(data):
        kind = _CLASS_OF[data]
        before = np.concatenate([[4], kind[:-1]])
        before[begins] = _CLASS_OF[10]
        width = N_CLASSES * N_CLASSES
        pairs = np.bincount(row * width + before * N_CLASSES + kind, minlength=total * width).reshape(total, width)
        size = np.bincount(row, minlength=total).astype(np.float32)
        features[:, :width] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
        features[:, width] = np.log1p(size) / 6
    features[:, -1] = 1
    return features, starts


@dataclass
class Network:
    """Weights of the encoder (a), the attention (v, u, w) and the document score (c, bias)."""

    a: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.a, self.v, self.u, self.w, self.c, self.bias]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        h = np.tanh(x @ self.a)
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.w
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        top = np.maximum.reduceat(e, starts)
        p = np.exp(e - top[bag])
        alpha = p / np.add.reduceat(p, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        return h, t, s, bag, alpha, z, z @ self.c + self.bias[0]

    def score_blocks(self, text: bytes) -> float:
        """The score of one long text from its blocks: the attention's sums are carried on under a running maximum."""
        top, total, held = -np.inf, 0.0, np.zeros(WIDTH)
        for at in range(0, len(text), BLOCK_BYTES):
            x, _ = encode_passages([text[at : at + BLOCK_BYTES]])
            h = np.tanh(x @ self.a)
            e = ((np.tanh(h @ self.v) / (1 + np.exp(-(h @ self.u)))) @ self.w).astype(np.float64)
            least, top = top, max(top, float(e.max()))
            p, shrink = np.exp(e - top), np.exp(least - top)
            total, held = total * shrink + p.sum(), held * shrink + p @ h
        return float(1 / (1 + np.exp(-np.clip(held / total @ self.c + self.bias[0], -30, 30))))

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1 per document."""
        return 1 / (1 + np.exp(-np.clip(self.forward(x, starts)[-1].astype(np.float64), -30, 30)))

    def gradient(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        h, t, s, bag, alpha, z, out = self.forward(x, starts)
        d = (1 / (1 + np.exp(-out)) - labels) / len(labels)
        dz = (d[:, None] * self.c)[bag]
        da = (dz * h).sum(1)
        de = alpha * (da - np.add.reduceat(alpha * da, starts)[bag])
        gated = de[:, None] * self.w
        dt, ds = gated * s * (1 - t * t), gated * t * s * (1 - s)
        dh = (alpha[:, None] * dz + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        return [x.T @ dh, h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()], dtype=np.float32)]


def fit(x: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss with weight decay; deterministic for given rows. No rows or one class: the prior only."""
    rng = np.random.default_rng(SEED)
    near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = Network(near(N_FEATURES, WIDTH), near(WIDTH, WIDTH), near(WIDTH, WIDTH), near(WIDTH), near(WIDTH), np.zeros(1, np.float32))
    n = len(labels)
    prior = (labels.sum() + 1) / (n + 2)
    net.bias[0] = np.log(prior / (1 - prior))
    if n == 0 or len(set(labels.tolist())) < 2:
        net.c[:] = 0
        return net
    ends = np.append(starts[1:], len(x))
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, epochs * -(-n // BATCH)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            chosen = order[at : at + BATCH]
            rows = np.concatenate([np.arange(starts[i], ends[i]) for i in chosen])
            sizes = ends[chosen] - starts[chosen]
            step += 1
            rate = RATE * (1 - step / (steps + 1)) / (1 - 0.9**step)
            grads = net.gradient(x[rows], np.cumsum(sizes) - sizes, labels[chosen])
            for p, g, m, q in zip(net.parts(), grads, first, second):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                p -= (rate * m / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _choose(rows: list, max_rows: int) -> list:
    """The first ``max_rows`` rows, but of either label FIT_LEAST (at most half of all) if there are so many."""
    least = min(FIT_LEAST, max_rows // 2)
    rows = sorted(rows, key=lambda r: (r["place"], r["id"], r["hash"], r["label"]))
    first = [r for x in (0, 1) for r in [r for r in rows if r["label"] == x][:least]]
    places = {id(r) for r in first}
    rest = [r for r in rows if id(r) not in places]
    return first + rest[: max_rows - len(first)]


def _share(sizes: list[int], max_bytes: int) -> int:
    """The greatest number of bytes up to which every text may count so that all together hold ``max_bytes`` at most."""
    left = max_bytes
    for at, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - at) > left:
            return max(1, left // (len(sizes) - at))
        left -= size
    return max(sizes, default=0)


def _spread(bag: np.ndarray, size: int, share: int) -> np.ndarray:
    """Of a text of ``size`` bytes as many passages, at even distances, as hold about ``share`` bytes; at least one."""
    if size <= share:
        return bag
    n = max(1, len(bag) * share // size)
    return bag[np.arange(n) * len(bag) // n]


def fit_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES, folds: int = FOLDS,
) -> Network:
    """A network fitted on labelled rows whose crc32(id) modulo ``folds`` is not 0.

    The sample is bounded: at most ``max_rows`` rows in the order of a hash of the id, FIT_LEAST of either label among them
    if there are so many, and about ``max_bytes`` bytes: if their texts hold more, all of them count up to one share of
    bytes, and a longer text gives passages at even distances (always one). Null ids and labels other than 0 and 1 are left out; repeated ids count as
    repeated rows. No labels at all give a network that scores every document 0.5.
    """
    limit_threads()
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & (id_bucket(F.col("id"), folds) != 0)
    )
    first = lambda rows, *more: [rows.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id", *more, "label").limit(max_rows) for x in (0, 1)]
    picked = DataFrame.union(*first(known))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    joined = texts.join(F.broadcast(picked), "id")  # at most max_rows narrow rows of either label
    sizes = joined.select("id", "hash", "label", F.octet_length("text").cast("long").alias("n"), F.xxhash64("id").alias("place"))
    chosen = _choose([r for part in first(sizes, "hash") for r in part.collect()], max_rows)
    share = _share([r["n"] for r in chosen], max_bytes)
    if not chosen:
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    times = Counter((r["id"], r["hash"], r["label"]) for r in chosen)
    keys = T.StructType([texts.schema["id"], T.StructField("hash", T.LongType()), sizes.schema["label"]])
    sample = joined.join(F.broadcast(docs.sparkSession.createDataFrame(list(times), keys)), keys.names).select(*keys.names, "text")
    schema = T.StructType([*sample.schema.fields[:3], T.StructField("features", T.BinaryType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=3, most=BLOCK_BYTES):
            raw = arrow_bytes(part.column(3))
            if len(raw) == 1 and len(raw[0] or b"") > BLOCK_BYTES:
                blocks = [raw[0][at : at + BLOCK_BYTES] for at in range(0, len(raw[0]), BLOCK_BYTES)]
                bag = b"".join(_spread(encode_passages([b])[0], len(b), max(1, share * len(b) // len(raw[0]))).tobytes() for b in blocks)
                yield record_batch(schema, [*part.columns[:3], [bag]])
                continue
            x, starts = encode_passages(raw)
            bags = [_spread(bag, len(text or b""), share).tobytes() for bag, text in zip(np.split(x, starts[1:]), raw)]
            yield record_batch(schema, [*part.columns[:3], bags])

    rows = []
    for row in sorted(sample.mapInArrow(encoded, schema).collect(), key=lambda r: (r["id"], r["hash"], r["label"])):
        times[row["id"], row["hash"], row["label"]] -= 1
        if times[row["id"], row["hash"], row["label"]] >= 0:
            rows.append(row)
    bags = [np.frombuffer(r["features"], dtype=np.float32).reshape(-1, N_FEATURES) for r in rows]
    counts = np.array([len(b) for b in bags])
    return fit(np.concatenate(bags), np.cumsum(counts) - counts, np.array([r["label"] for r in rows], dtype=np.float32))


def score_documents(docs: DataFrame, net: Network, carry: list[str], text_col: str = "text") -> DataFrame:
    """The struct ``row`` of columns ``carry`` and ``score`` (probability of label 1) for every row.

    Null and empty texts are scored as one empty passage. Texts are read whole. Rows are neither merged nor dropped.
    """
    chosen = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType().add(chosen.schema["row"]).add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        for part in slices(batches, text=1, most=BLOCK_BYTES):
            texts = arrow_bytes(part.column(1))
            if len(texts) == 1 and len(texts[0] or b"") > BLOCK_BYTES:
                yield record_batch(schema, [part.column(0), [net.score_blocks(texts[0])]])
                continue
            x, starts = encode_passages(texts)
            yield record_batch(schema, [part.column(0), net.score(x, starts)])

    return chosen.mapInArrow(scored, schema)
