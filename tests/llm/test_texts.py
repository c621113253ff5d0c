"""Byte BPE, token files, sharding, URL filters, decontamination against brute force and round trips."""

import itertools
import random
from collections import Counter

import brute
import fixture
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forum_signals.llm import byte_bpe, decontamination, queries, sharding, token_output, url_filter
from forum_signals.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return fixture.documents(spark)


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1_024), (200, 40)])
def test_byte_bpe(docs, chunk, overlap):
    """Also in chunks of 200 characters, some of which never resynchronise."""
    encoded = byte_bpe.encode(docs, *BPE, chunk=chunk, overlap=overlap)
    decoded = byte_bpe.decode(encoded.select(F.col("row.doc_id").alias("doc_id"), "ids"), *BPE)
    fixture.same(queries.bpe_digest(decoded), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], brute.byte_bpe(fixture.as_dicts()))
    assert encoded.select("row.*").columns == docs.columns


def test_chunks_that_end_in_blanks(spark):
    """Every place of a cut in texts full of runs of blanks and contractions gives the library's ids."""
    rng = random.Random(6)
    bits = ["a", "\n\n", "\t\t", " \n ", "don't", " 've", "  ", "x1", "\u00a0\u00a0", "…", "\r\n\r\n", "日本", "!!", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(150, 260))) for _ in range(60)]
    texts += ["word " * 20 + "a\n\n" + "bcd efg " * k for k in range(20, 40)] + ["\n" * 300, "a" * 300]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    expected = [(r[0], r[1], r[2]) for r in brute.byte_bpe([{"doc_id": i, "text": t} for i, t in enumerate(texts)])]
    for chunk, overlap in ((50, 20), (67, 33), (101, 30)):
        encoded = byte_bpe.encode(frame, *BPE, chunk=chunk, overlap=overlap)
        decoded = byte_bpe.decode(encoded.select(F.col("row.doc_id").alias("doc_id"), "ids"), *BPE)
        fixture.same(queries.bpe_digest(decoded), ["doc_id", "n_tokens", "ids_sha256"], expected)


def test_byte_bpe_of_nothing(docs):
    assert byte_bpe.encode(docs.limit(0), *BPE).count() == 0


def test_token_files(spark, docs):
    path = scratch_path(spark, "tokens")
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    token_output.write_tokens(plain, path, WORDS, 2, files=4)
    expected = brute.token_output([r.asDict() for r in plain.collect()])
    fixture.same(token_output.token_digest(spark, path), ["doc_id", "start", "n_tokens", "ids_crc32"], expected)
    # the files are in ascending order, and a filter on the id reaches them
    spans = token_output.read_tokens(spark, path).groupBy(F.input_file_name()).agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))
    plan = token_output.read_tokens(spark, path).where("id = 12")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,12)" in plan


def test_token_files_of_odd_rows(spark, docs):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(docs, path, WORDS, 2, files=3)
    got = token_output.token_digest(spark, path).orderBy("start").collect()
    assert len(got) == docs.count() and [r.doc_id for r in got[:2]] == [None, None]
    assert list(itertools.accumulate((r.n_tokens for r in got), initial=0))[:-1] == [r.start for r in got]
    token_output.write_tokens(docs.limit(0), path + "-none", WORDS, 2)
    assert token_output.token_digest(spark, path + "-none").count() == 0


def test_words_are_encoded_as_the_library_does():
    words, rng = token_output.Words(WORDS), random.Random(1)
    alphabet = "abcXYZ019 '-.,!ÀÉßçñÿ×÷ªµİΣ\u0301e \u3000中文😀<|>\x00\x1c\x85'srelvdm\n\t"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) + ("<|endoftext|>x" if i % 40 == 0 else "") for i in range(4_000)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts], b"")):
        assert np.frombuffer(ids, dtype="<i4").tolist() == words.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dimensions, bits):
    """Every cell has its own index, and neighbours on the curve are neighbours in space."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, docs, law):
    path = scratch_path(spark, "shards")
    got = sharding.write_shards(docs, path, law=law, shards=5, runs=7).collect()
    expected = [(r["doc_id"], len(brute.utf8(r["text"])) + 1) for r in fixture.as_dicts()]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.size)) for r in got)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    if law == "rows":
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1 and len(by_shard) == 5
    else:
        largest = max(r.size for r in got)
        sizes = [sum(r.size for r in rows) for rows in by_shard.values()]
        assert max(sizes) <= sum(r.size for r in got) / 5 + largest
    assert spark.read.parquet(path).select("row.*").columns == docs.columns
    assert sharding.write_shards(docs.limit(0), path + "-none").count() == 0


def test_files_are_pruned_by_any_dimension(spark, tmp_path):
    frame = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 16).alias("source"), (F.col("id") * 7919 % 1000).alias("n_chars"),
        F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.hash("id") % 4 + 4).cast("int") % 4 + 1).alias("lang"), F.lit("t").alias("text"),
    )
    sharding.write_shards(frame, str(tmp_path / "s"), runs=32)
    files = spark.read.parquet(str(tmp_path / "s")).groupBy("run").agg(
        F.min("row.source").alias("s0"), F.max("row.source").alias("s1"), F.min("row.n_chars").alias("n0"), F.max("row.n_chars").alias("n1")
    ).collect()
    assert sum(r.s0 <= "s3" <= r.s1 for r in files) <= 20 and sum(r.n0 <= 500 <= r.n1 for r in files) <= 20


def test_url_rules(spark):
    urls = [
        "https://www.example.com/en/1", "http://a.example.com/en/1?x", "HTTP://WWW.EXAMPLE.COM/en/2#f", "http://example.com", "http://x.net/es/1",
        "http://x.net/de/1", "no scheme", None, "", "://net/fr/", "http://xnet/es/1", "http://a.b.net/fr/?://com/", "//x://y.com/en/", "http://İX.com/",
        "http://a.org/1", "http://x.net/es/1",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, queries.URL_RULES, spark.createDataFrame([], "a string, b string"))
    expected = []
    for i, url in enumerate(urls):
        host, path = brute.host_path(url)
        rule = brute.url_rule(host, path, queries.URL_RULES)
        expected.append((i, host, path, rule and rule[0] + rule[1], rule[2] if rule else "allow"))
    fixture.same(got, ["page_id", "host", "path", "rule", "verdict"], expected)
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES, spark.createDataFrame([], "a string, b string")).count() == 0


def test_redirect_equivalence(spark):
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow")]
    html = lambda target: f'<head><LINK href="{target}" data-x=1 rel="canonical"></head>'
    rows = [
        (1, "http://a.io/1", html("http://b.io/1")), (2, "http://b.io/1", html("http://bad.org/x")),
        (3, "http://c.io/", '<meta http-equiv="refresh" content="0; URL=http://d.io/">'), (4, "http://d.io/", html("http://bad.org/y")),
        (5, "http://e.io/", html("http://d.io/")), (6, "http://f.io/", html("http://good.org/z")), (7, "http://good.org/z", html("http://bad.org/y")),
        (8, "http://alone.io/", None), (9, "http://bad.org/x", ""), (10, None, html("http://bad.org/q")), (11, "http://g.io/", html("/relative")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.reason) for r in url_filter.judge_urls(pages, rules, url_filter.page_links(pages)).collect()}
    assert got == {
        1: ("block", "alias"), 2: ("block", "alias"), 9: ("block", "rule"),
        # an allow among the aliases goes before the block of bad.org/y, which keeps its own rule
        3: ("allow", "alias"), 4: ("allow", "alias"), 5: ("allow", "alias"), 6: ("allow", "alias"), 7: ("allow", "rule"),
        8: ("allow", "default"), 10: ("allow", "default"), 11: ("allow", "default"),
    }


def test_targets_are_resolved_and_spellings_are_one_page(spark):
    from urllib.parse import urljoin

    page = "HTTPS://Www.A.io/dir/page.html?q=1#top"
    targets = [
        "x", "x/y?z=1", "./x", "../x", "../../../x", "/x/./y/../z", "/x/..", "/x/.", "..", ".", "//B.io/Q", "?q=2", "/a&amp;b?c=1&amp;d=2",
        "HTTP://B.io/Case#f", "http://b.io", "/", "/a..b/..c", "é/ü",
    ]
    frame = spark.createDataFrame([(i, page, t) for i, t in enumerate(targets)], "i int, page string, t string")
    got = {r.i: r.u for r in frame.select("i", url_filter.resolved(F.col("t"), F.col("page")).alias("u")).collect()}
    assert got == {i: urljoin("https://www.a.io/dir/page.html?q=1", t.replace("&amp;", "&").split("#")[0].replace("HTTP://B", "http://b").replace("//B", "//b")) for i, t in enumerate(targets)}
    nowhere = spark.createDataFrame([("", page), ("#top", page), ("mailto:a@b.io", page), ("x", "no scheme"), (None, page), ("x", None)], "t string, page string")
    assert nowhere.where(url_filter.resolved(F.col("t"), F.col("page")).isNotNull()).count() == 0
    html = lambda target: f'<link rel="canonical" href="{target}">'
    rows = [
        (1, "http://a.io/d/1", html("../2")), (2, "http://A.IO/2#frag", html("//Bad.org/x?a=1&amp;b=2")), (3, "http://bad.org/x?a=1&b=2", None),
        (4, "http://a.io/4", html("#self")), (5, "http://a.io/d/1#part", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge_urls(pages, [("bad.org", "/", "block")], url_filter.page_links(pages)).collect()
    assert {r.page_id: (r.verdict, r.reason) for r in got} == {
        1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "rule"), 4: ("allow", "default"), 5: ("block", "alias"),
    }


def test_wand_finds_what_scoring_everything_finds():
    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(400)]
    items = [(i, " ".join(f"w{w}" for w in rng.choices(range(400), weights, k=rng.randint(3, 30)))) for i in range(300)]
    index = decontamination.build_index(items)
    for threshold in (0.2, 0.5, 0.9):
        retriever = decontamination.Retriever(index, threshold)
        for _ in range(40):
            terms = sorted(set(rng.choices(range(len(index.terms)), k=25)) | set(rng.choice(index.questions)))
            scores = np.zeros(len(items))
            for t in terms:
                a, b = index.first[t], index.first[t + 1]
                scores[index.items[a:b]] += index.impacts[a:b]
            expected = {int(i): scores[i] for i in np.flatnonzero(scores >= threshold - 1e-9)}
            assert dict(retriever.search(terms)) == pytest.approx(expected)


def test_ruling_out_loses_no_passage():
    """Every passage that reaches the threshold for an item is among those that go on, whatever terms are selective."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 20)))) for i in range(100)]
    index = decontamination.build_index(items)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 200))) for _ in range(60)] + [f"x {t} y" for _, t in items] + [None, "", "..."]
    all_open = decontamination.build_index(items)
    all_open.open, all_open.selective = True, np.zeros(len(index.terms), bool)
    all_open.granted = np.ones(len(items))
    found = [
        list(decontamination.leaks_in(pa.array(texts, type=pa.large_string()), ix, decontamination.Retriever(ix, 0.5), 0.5))
        for ix in (index, all_open)
    ]
    assert found[0] == found[1] and {r[0] - 60 for r in found[0]} >= set(range(100))


def test_leaks(spark):
    question = "Which river flows through the old town of Bern and where does it rise"
    items = [(1, question + "? The Aare rises in the Bernese Alps."), (2, "short"), (3, None), (4, "..."), (5, "What is it? " + "common words here " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(300))
    docs = [
        (1, f"{filler} {question.upper()}?\n\nthe AARE, rises in the (Bernese) Alps!! {filler}"), (2, question), (3, "The Aare rises in the Bernese Alps."),
        (4, None), (5, ""), (6, filler), (7, f"a short word {filler}"), (None, f"x {items[0][1]}"), (8, items[4][1]), (8, items[4][1]),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    got = sorted(str((r.doc_id, r.item_id)) for r in decontamination.find_leaks(frame, bench).collect())
    assert got == sorted(map(str, [(1, 1), (7, 2), (None, 1), (8, 5), (8, 5)]))
    kept = decontamination.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6"]
    assert decontamination.find_leaks(frame.limit(0), bench).count() == 0 == decontamination.find_leaks(frame, bench.limit(0)).count()
    assert decontamination.drop_leaks(frame, bench.limit(0)).count() == len(docs)
    parts = list(decontamination.index_blocks(bench, "item_id", "text", size=2))
    assert sorted(i for p in parts for i in p.item_ids) == [1, 2, 5]


@pytest.mark.parametrize("answer", ["bernese alps hide this spring", "it rises far up in the bernese alps", "yes"])
def test_leaks_of_edited_answers(spark, answer):
    """An item with one word of its answer changed still leaks if the answer has four words or more; a question alone never does."""
    question = "Which river flows through the old town of Bern and where does it rise"
    words = answer.split()
    bench = spark.createDataFrame([(1, f"{question}? {answer}."), (2, "one two three four five")], "item_id long, text string")
    edited = [f"some {question} " + " ".join([*words[:i], "changed", *words[i + 1 :]]) + " after" for i in range(len(words))]
    docs = [*edited, f"{question}? {answer}", question, f"{question} and nothing of that kind is here", "one two five four three"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, bench).collect())
    assert got == [(i, 1) for i in range(len(words) + 1) if len(words) > 1 or i == 1]


def test_runs_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_BYTES", 1_000)
    docs = spark.createDataFrame([(i, "s", "en", i, "x" * 99) for i in range(200)], "doc_id long, source string, lang string, n_chars int, text string")
    got = sharding.write_shards(docs, scratch_path(spark, "grown"), shards=4).collect()
    assert len({r.run for r in got}) > 15 and {r.shard: 50 for r in got} == Counter(r.shard for r in got)


def test_links_of_unclosed_elements(spark):
    """A megabyte of elements that never end is read in one pass, and hides no element after it."""
    import time

    html = "<link " * 200_000 + '<link rel="canonical" href="http://a.com/x">' + "<meta http-equiv=refresh content='0;url=http://b.com/'>"
    pages = spark.createDataFrame([(1, "http://a.com/y", html), (2, "http://a.com/z", None)], "page_id long, url string, html string")
    url_filter.page_links(pages).count()
    start = time.time()
    assert {r.target for r in url_filter.page_links(pages).collect()} == {"http://a.com/x", "http://b.com/"}
    assert time.time() - start < 10
