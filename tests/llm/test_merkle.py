"""The Merkle manifest against a plain recursive one."""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pytest

from forum_signals.llm import merkle, queries


def digest(*hex_texts: str) -> str:
    return hashlib.sha256("".join(hex_texts).encode()).hexdigest()


def tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """The root and every leaf's siblings, level by level, by the contract's words."""
    proofs: list[list[str]] = [[] for _ in leaves]
    spans, nodes = [[i] for i in range(len(leaves))], leaves
    while len(nodes) > 1:
        parents, joined = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for leaf in spans[at + k]:
                    proofs[leaf] += run[:k] + run[k + 1 :]
            parents.append(digest(*run))
            joined.append(sum(spans[at : at + 3], []))
        nodes, spans = parents, joined
    return nodes[0], proofs


def encoded(values: tuple) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def expected(rows: list[tuple]) -> list[tuple]:
    """Rows of (doc_id, source, lang, n_chars, text) to the contract's result."""
    by = sorted(rows, key=lambda r: ((0, b"") if r[1] is None else (1, r[1].encode()), (0, 0) if r[0] is None else (1, r[0]), encoded(r)))
    groups = [list(g) for _, g in groupby(by, key=lambda r: r[1])]
    trees = [tree([encoded(r) for r in g]) for g in groups]
    if not trees:
        return []
    root, upper = tree([t[0] for t in trees])
    out = []
    for g, (subroot, proofs), above in zip(groups, trees, upper):
        for row, proof in zip(g, proofs):
            changed = row
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            out.append((row[0], encoded(row), subroot, root, digest(*proof, *above), encoded(changed) == encoded(row)))
    return out


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 20)


def documents(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def ran(spark, folder, height=2) -> list[tuple]:
    rows = queries.manifest_digest(spark.read.parquet(f"{folder}/documents.parquet"), height).collect()
    for r in rows:
        assert r.verified == (r.folded_root == r.root)
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows]


def by_value(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1, 1], [3, 9, 10, 27, 28, 100], [82, 243, 244], [1] * 13])
def test_like_the_plain_tree(spark, tmp_path, small_tasks, sizes):
    rows = [(100 * i + 7 * k, f"s{i}", "en", k, f"line {k}\nof {i}") for i, n in enumerate(sizes) for k in range(n)]
    assert by_value(ran(spark, documents(spark, rows, tmp_path))) == by_value(expected(rows))


def test_odd_rows(spark, tmp_path, small_tasks):
    """Nulls in every column, repeated rows and ids, empty and long texts, sources outside ASCII."""
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (3, None, "en", 1, ""), (3, "é", None, 2, "a\nb"), (3, "é", None, 2, "a\nc"),
        (-5, "z", "de", None, "\n" * 9), (4, "Z", "de", 0, "é" * 200_000 + "\n"), (6, "", "x", 1, "\r\n"), (6, "", "x", 1, "\r\n"),
    ]
    assert by_value(ran(spark, documents(spark, rows, tmp_path))) == by_value(expected(rows))


def test_empty_table(spark, tmp_path):
    assert ran(spark, documents(spark, [], tmp_path), merkle.HEIGHT) == []


def test_log_is_in_completion_order(spark, small_tasks):
    """Positions number a tree's nodes without a gap, a parent stands right after its last child, and the root is last."""
    totals = [1, 2, 3, 8, 9, 10, 26, 28, 80, 244]
    leaves = [(f"{n:03}", i, f"{i:064x}", f"{i:064x}") for n in totals for i in range(n)]
    manifest = merkle.build(spark.createDataFrame(leaves, "group string, id long, leaf string, claim string"), height=2)
    log = manifest.log().collect()
    for number, total in enumerate(totals):
        rows = sorted((r for r in log if r.tree == number), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        at = {(r.level, r["index"]): r for r in rows}
        for r in rows:
            if r.level:
                first = 3 * r["index"]
                children = [at[r.level - 1, i] for i in range(first, first + 3) if (r.level - 1, i) in at]
                assert digest(*[c.digest for c in children]) == r.digest
                assert max(c.position for c in children) == r.position - 1
        assert rows[-1].digest == tree([f"{i:064x}" for i in range(total)])[0]
