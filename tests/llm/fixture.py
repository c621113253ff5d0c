"""A small table of documents with every odd case, and helpers to run queries on it."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, seq long, hash long, score double"


def rows():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Idea", "stone", "naïve", "Größe", "river", "blue", "sea", "cat", "sat", "mat", "over", "under", "x1", "…"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(n))
    shared, copy, near = prose(30), prose(60), prose(120)
    line = "every page ends with this one very common line of exactly fourteen words here ok"
    long_text = prose(9_000)
    texts = [
        (1, copy), (2, copy.replace(" ", "\n\t")), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, prose(20)), (6, None),
        (7, prose(40)), (7, prose(25)), (None, copy), (None, "no id"), (8, near), (9, near + " end"), (10, near.replace("idea", "Idea")),
        (11, prose(15) + " " + shared + " " + prose(5)), (12, shared), (13, prose(9) + "\n" + shared), (14, long_text), (15, long_text[:-30] + prose(4)),
        (16, "a" * 40_000), (17, "b" + " " * 3_000 + "c" + "\n" * 40), (18, "don't 're we'll ’s 中文 😀 e\u0301 \u00a0 \u3000 x\x1cy\x85z"),
        (19, "<|endoftext|> ordinary <|startoftext|>x"), (20, prose(3) + " " + line), (21, line + " " + prose(3)), (22, line), (23, "Word"), (24, "word"),
        (9_000_000_000, copy.upper()), (-5, prose(12)), (25, "Ab\u00a0cd"), (26, "ab\u00a0CD"), (27, shared + " " + shared),
    ]
    texts += [(30, texts[5][1]), (30, texts[5][1]), (30, texts[5][1])]  # repeated rows
    kinds = [("en", "a"), (None, "b"), ("de", None), ("", "ü"), (None, None)]
    out = []
    for at, (number, text) in enumerate(texts):
        lang, source = kinds[at % len(kinds)]
        out.append((number, text, lang, source, None if at % 7 == 3 else len(text or ""), at % 3, "r", None, 5, 0.5))
    return out


def documents(spark, parts=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def as_dicts():
    return [{"doc_id": r[0], "text": r[1]} for r in rows()]


def same(frame, columns, expected):
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)
    assert got == sorted(expected, key=str)
