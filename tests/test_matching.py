import random

import pytest
from pyspark.sql import functions as F

from expansion import PYTHON_PATTERNS, expand
from forum_signals.functions import matching
from forum_signals.functions.lexicon import CATEGORY_COLUMNS, PHRASES


def flags_of(spark, texts):
    """Spark's flags per text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = matching.with_flags(df, F.col("text"), ["id"]).orderBy("id").collect()
    return [{c: r[c] for c in (matching.HAS_MISCOMM, *CATEGORY_COLUMNS)} for r in rows]


def expected(text):
    cats = {f"cat_{name}": bool(p.search(text or "")) for name, p in PYTHON_PATTERNS.items()}
    return {matching.HAS_MISCOMM: any(cats.values()), **cats}


def assert_parity(spark, texts):
    wrong = [(t, o, expected(t)) for t, o in zip(texts, flags_of(spark, texts)) if o != expected(t)]
    assert not wrong, f"{len(wrong)} differ, e.g. {wrong[0]}"


def test_lexicon_size():
    assert len(PHRASES) == 13 and sum(map(len, PHRASES.values())) == 128


def test_every_phrase_matches_its_category(spark):
    samples = [(name, text) for name, group in PHRASES.items() for p in group for text in expand(p)]
    assert len(samples) > 400
    texts = [f"Well, {text.upper() if i % 2 else text}?" for i, (_, text) in enumerate(samples)]
    for (name, text), flags in zip(samples, flags_of(spark, texts)):
        assert flags[f"cat_{name}"] and flags["has_miscomm"], (name, text)
    assert_parity(spark, texts)


def test_near_misses(spark):
    texts = [
        "i see nowhere", "how does it start", "which parts", "faster than whatever", "for all casesx",
        "you meant it", "xdo you mean", "what is the pointless", "per item and overall", "i’m not sure what you",
        "what do you mean by\n", "which a_b takes priority", "is this format ok", "", None, "what does  mean",
    ]
    assert_parity(spark, texts)
    assert not flags_of(spark, ["i see nowhere"])[0]["has_miscomm"]
    assert not flags_of(spark, ["i’m serious"])[0]["has_miscomm"]  # only the ASCII apostrophe counts


def test_slots(spark):
    gap = "x" * 80
    texts = [
        f"if by {gap} you mean", f"if by {gap}x you mean", "if by a\nb you mean", "if by a\rb you mean",
        "if by a b you mean", "what is a-b-c for", "what is a--b for", "what is a_b for", "what is é for",
        "what is foo for", "what is meant by a-b_", "what is meant by a_", "what is meant by aé",
        "what is\x1cfoo for", "what is\x0bfoo for", "what is\x85foo for", "does each \n have", "does each é have",
    ]
    assert_parity(spark, texts)
    assert flags_of(spark, texts[:2])[0]["cat_comprehension_failure"]


def test_long_chain_of_hyphens(spark):
    text = "what does " + "a-" * 50_000 + "b mean"
    assert flags_of(spark, [text, text + "é"])[0]["cat_terminology"]
    assert_parity(spark, ["what is meant by " + "a-" * 20_000 + "_"])


PIECES = [
    "you", "mean", "what", "is", "this", "that", "it", "do", "does", "each", "every", "i", "i'm", "i'm not", "sure",
    "by", "for", "per item", "overall", "or", "and", "how", "are", "saying", "both", "applies to both", "which", "one",
    "has", "priority", "have", "if", "can't", "tell", "the", "point", "of", "trying to do", "foo-bar", "x_y", "42", ".",
    ",", "?", "should", "all", "be", "than", "units", "in", "include", "see", "now", "totally", "serious", "wait,",
    "didn't", "say",
]
ODD = ["é", "’", "\xa0", " ", " ", "ſ", "K", "İ", "ı", "\n", "\r", "\t", "\x0b", "\x1c", "\x85", "_", "中", "́", "²"]


@pytest.mark.parametrize("odd", [False, True])
def test_random_texts(spark, odd):
    rng = random.Random(7)
    samples = [t for group in PHRASES.values() for p in group for t in expand(p)]
    texts = []
    for _ in range(6000):
        words = [rng.choice(PIECES) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words) + 1), rng.choice(samples))
        text = rng.choice([" ", " ", " ", "  ", "\n"]).join(words)
        if rng.random() < 0.3:
            text = text.upper()
        for _ in range(rng.randint(0, 4) if odd else 0):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(ODD) + text[at + rng.randint(0, 1) :]
        texts.append(text)
    assert_parity(spark, texts)


def test_single_columns_agree_with_the_staged_form(spark):
    texts = ["how do I start", "é is this for you", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = matching.detect_categories(F.col("text"))
    rows = df.select("id", matching.contains_miscomm(F.col("text")).alias("any"), *[c.alias(n) for n, c in found.items()])
    for row, staged in zip(rows.orderBy("id").collect(), flags_of(spark, texts)):
        assert row["any"] == staged["has_miscomm"]
        assert all(row[name] == staged[f"cat_{name}"] for name in PHRASES)


def test_phrases_after_the_first_one(spark):
    """Phrases within, right behind and far behind the first one count; letters cut off by it start none."""
    texts = [
        "which part", "which part how do i", "what do you mean by which one", "i can't tell if you're serious",
        "if by is this for you mean", "i see now\nin what units", "xwhich part, i see now", "i see nowwhich part",
        "so you're saying each", "ſo you're ſaying which one é", "éhow do i how do i", "i'm i'm serious", "do you mean all than what",
    ]
    assert_parity(spark, texts)
    assert flags_of(spark, ["which part how do i"])[0]["cat_actionability"]


def test_categories_are_tried_at_one_place(spark):
    """A text with one phrase is not searched thirteen times: each category has an expression for a text's beginning."""
    flagged = matching.with_flags(spark.createDataFrame([("which part",)], "text string"), F.col("text"), ["text"])
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?id)\A") == len(PHRASES) and plan.count(r"(?iud)\A") == len(PHRASES)
