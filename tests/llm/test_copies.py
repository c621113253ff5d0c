"""Substring dedup, exact dedup, SimHash, components and the FM-index against brute force."""

import random

import brute
import fixture
import numpy as np
import pytest

from forum_signals.llm import components, exact_dedup, simhash, substring_dedup
from forum_signals.llm.fm_index import FMIndex

EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
SPANS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.fixture(scope="module")
def docs(spark):
    return fixture.documents(spark)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("bucket_bytes", [32_000_000, 500])
def test_exact_copies(docs, bucket_bytes):
    """With buckets of 500 bytes the directory is doubled many times."""
    fixture.same(exact_dedup.exact_copies(docs, bucket_bytes=bucket_bytes), EXACT, brute.exact_dedup(fixture.as_dicts()))


def test_directory_splits_overfull_buckets_only(spark):
    keys = [(k << 48) - (1 << 63) for k in (0, 1, 2, 3)] + [(1 << 62) + 5]
    frame = spark.createDataFrame([(k, 10) for k in keys], "key long, n_bytes long")
    buckets = exact_dedup.build_directory(frame, bucket_bytes=10)
    assert sum(2.0**-depth for depth, _ in buckets) == 1  # every key has exactly one bucket
    assert max(depth for depth, _ in buckets) == exact_dedup.MAX_DEPTH and (1, 1) in buckets


def test_kept_rows_have_all_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    expected = [r[0] for r in brute.exact_dedup(fixture.as_dicts()) if r[3]]
    assert sorted(map(str, expected)) == sorted(str(r.doc_id) for r in kept.collect())


def test_equal_keys_are_told_apart_by_their_bytes():
    """A chain holds different texts of one key."""
    from forum_signals.llm.common import record_batch
    from pyspark.sql import types as T

    schema = T.StructType().add("bucket", "integer").add("key", "long").add("lid", "long").add("body", "string")
    batch = record_batch(schema, [[0] * 4, [7] * 4, [1, 2, 3, 4], ["x", "y", "x", "y"]])
    out = [tuple(r.values())[:2] for part in exact_dedup._chain(iter([batch])) for r in part.to_pylist()]
    assert out == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_simhash(docs):
    fixture.same(simhash.near_duplicates(docs), ["doc_id", "fingerprint", "component_id"], brute.simhash(fixture.as_dicts()))


def test_links_connect_all_fingerprints_within_two_bits(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    for _ in range(200):
        value = rng.choice(prints)
        for bit in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
            value ^= 1 << bit
        prints.append(value)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.near_groups(spark.createDataFrame(signed, "fp long"))
    got = {r.fp % (1 << 64): r.root for r in found.collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = brute.components(len(prints), links)
    linked = {i for pair in links for i in pair}
    assert set(got) == {prints[i] for i in linked}
    groups = {}
    for i in linked:
        groups.setdefault(root[i], set()).add(got[prints[i]])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def near_copies(dicts, width=3, radius=2):
    """Components of fingerprints within two bits."""
    prints = [brute.fingerprint(d["text"], width) for d in dicts]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    return brute.components(len(dicts), links)


def test_near_copies_stage(docs):
    dicts = fixture.as_dicts()
    root, best = near_copies(dicts), {}
    for d, r in zip(dicts, root):
        best[r] = min(best.get(r, (True, 1)), brute.last(d["doc_id"]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (None if none else n for none, n in best.values()))) == sorted(str(r.doc_id) for r in kept.collect())


def kept_of(spark, texts):
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    return sorted(r.doc_id for r in kept.collect())


def kept_by_brute(texts):
    root = near_copies([{"text": t} for t in texts])
    return sorted({r: i for i, r in reversed(list(enumerate(root)))}.values())


def test_near_copies_of_edited_texts(spark):
    """Long texts with one word changed, short and blank texts; ids in any order of rows."""
    rng = random.Random(8)
    texts = ["", " \n", "one", "ONE", "one two"]
    for n in (5, 60, 400, 1_500):
        for _ in range(8):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, "x"]), " ".join([*words[:-1], "x"]), " ".join(words).upper()]
    expected = kept_by_brute(texts)
    assert len(expected) < len(texts) / 2 and kept_of(spark, texts) == expected


@pytest.mark.parametrize("hot_value", [1, 6, 64])
def test_segment_tables(spark, hot_value):
    """Families that share a segment, in which most matches are farther than two bits; with few and with all values hot."""
    rng = random.Random(hot_value)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(6):
        high, low = rng.getrandbits(32) << 32, rng.getrandbits(32)
        prints |= {high | rng.getrandbits(32) for _ in range(15)} | {(rng.getrandbits(32) << 32) | low for _ in range(15)}
    for base in list(prints)[:60]:
        for _ in range(rng.randint(1, 4)):
            base ^= 1 << rng.randrange(64)
            base ^= (1 << rng.randrange(64)) * rng.randrange(2)
            prints.add(base)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    near = {(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2}
    unsigned = lambda r: tuple(sorted((x & ((1 << 64) - 1) for x in r), reverse=True))
    found = {unsigned(r) for r in simhash.links(frame, hot_value).collect()}
    at = {p: i for i, p in enumerate(prints)}
    indexed = lambda pairs: [(at[a], at[b]) for a, b in pairs]
    # the same rows are together, whatever their component is called
    parts = [brute.components(len(prints), indexed(pairs)) for pairs in (found, near)]
    assert found <= near and len(set(parts[0])) == len(set(parts[1])) == len(set(zip(*parts)))
    matches, _ = simhash.segment_matches(frame, hot_value)
    if hot_value == 64:
        assert found == near and matches.where(~simhash._near("fp", "other")).count() > 100


def test_columns_of_any_name(spark):
    """Dots, backticks and names the operators use themselves."""
    from forum_signals.llm import byte_bpe, decontamination, queries, sharding
    import public_tokenizers

    given = [(1, "a b c", 5, "x", 0), (2, "a b  c", 6, None, 1), (3, None, None, "y", 2)]
    frame = spark.createDataFrame(given, ["doc_id", "text", "a.b", "q`r", "row.x"])
    bench = spark.createDataFrame([(1, "q u e s t i o n an swer")], "item_id long, text string")
    for kept in (exact_dedup.drop_copies(frame), simhash.keep_one(frame), decontamination.drop_leaks(frame, bench)):
        assert kept.columns == frame.columns and {r[0] for r in kept.collect()} >= {3}
    assert byte_bpe.encode(frame, public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.PATTERN).count() == 3


@pytest.mark.parametrize(("hot", "shard_words", "block_bytes"), [(1_000, 400_000, 24_000_000), (2, 300, 3_000)])
def test_substring_dedup(docs, hot, shard_words, block_bytes):
    """Also with many small blocks and shards, and nearly every anchor hot."""
    found = substring_dedup.repeated_spans(docs, hot_segments=hot, shard_words=shard_words, block_bytes=block_bytes, owned=2_000)
    fixture.same(found, SPANS, brute.substring_dedup(fixture.as_dicts()))
    for r in found.collect():
        assert sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed


def test_empty_tables(empty):
    assert exact_dedup.exact_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + chain + [(7, i) for i in range(200, 240)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    root, least = brute.components(300, real), {}
    for node in sorted({n for e in real for n in e}):
        least.setdefault(root[node], node)
    assert got == {n: least[root[n]] for e in real for n in e}


def test_search_ends_at_a_single_occurrence(monkeypatch):
    """The same intervals in fewer steps, for patterns of the indexed sequences themselves."""
    rng = np.random.default_rng(9)
    sequences = [rng.integers(1, 40, rng.integers(0, 30)) for _ in range(60)]
    sequences += [sequences[5][:20], np.concatenate([sequences[7], sequences[7]]), np.ones(25, dtype=np.int64)]
    symbols = np.concatenate([np.append(s, 0) for s in sequences])
    index = FMIndex(symbols, 40, max(map(len, sequences)))
    ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
    starts = np.concatenate([np.arange(e - len(s), e - 6) for s, e in zip(sequences, ends.tolist())])
    patterns, steps = symbols[starts[:, None] + np.arange(7)], []
    plain = index.search(patterns)
    occurrences = index.wavelet.occurrences
    monkeypatch.setattr(index.wavelet, "occurrences", lambda symbol, at: steps.append(len(at)) or occurrences(symbol, at))
    found = index.search(patterns, index.places()[starts])
    assert (found[0] == plain[0]).all() and (found[1] == plain[1]).all()
    assert (plain[1] > plain[0]).all() and (plain[1] - plain[0]).max() > 1
    assert sum(steps) < 2 * 7 * len(patterns) * 2 / 3


def test_fm_index():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(1, 6, rng.integers(1, 40)).tolist() for _ in range(60)]
    symbols = np.array([s for q in sequences for s in (*q, 0)])
    index = FMIndex(symbols, 6, max(map(len, sequences)))
    occurrences = lambda p: sum(q[i : i + len(p)] == p for q in sequences for i in range(len(q)))
    for length in (1, 3, 5):
        patterns = rng.integers(1, 6, (50, length))
        low, high = index.search(patterns)
        assert (high - low).tolist() == [occurrences(p) for p in patterns.tolist()]
    stream = rng.integers(1, 6, 80)
    best = index.matching_statistics(stream, 6)
    for end in range(80):
        lengths = [n for n in range(1, min(6, end + 1) + 1) if occurrences(stream[end - n + 1 : end + 1].tolist())]
        assert best[end] == max(lengths, default=0)
