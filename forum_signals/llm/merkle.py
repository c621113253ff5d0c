"""Merkle manifest of a dataset, kept as a postorder append log.

Every group (a source) is a tree with ARITY children per node over its leaves in order; the last node of a level may have fewer
children. The groups' roots, in the groups' order, are the leaves of one more tree of the same form, whose root names the dataset.

1. ``placed``: rows get their rank within their group from a range-partitioned sort and one count per task and group, so a group
   of any size is sorted by many tasks.
2. ``_built``: builders take aligned blocks of ARITY ** HEIGHT nodes, at most, and append each block's nodes to its log in
   completion order: a node is written right after its last child. How large the subtrees left of a node are follows from its level and index
   alone, so ``positions`` gives every node's place in closed form. Block roots are the nodes of the next round of
   builders; a tree over 10^12 leaves has four rounds.
3. ``_proved``: proofs are read from the logs from the top down. A block's leaves share all siblings above the block, which come
   with the block as one path; the siblings inside are addressed by their positions in the block's log.

What moves is one digest per row, and one path per block. Texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm.common import record_batch, size_tasks, stored

ARITY = 3
#: Levels a builder adds: a block has at most 3 ** 7 = 2,187 nodes at its bottom.
HEIGHT = 7
DIGEST = 32
#: Rows (about 100 bytes each) a task sorts.
ROWS_PER_TASK = 500_000

_RUN = (
    T.StructType().add("tree", "long").add("block", "long").add("total", "long").add("log", "binary")
    .add("ids", T.ArrayType(T.LongType())).add("claims", "binary")
)
_PATH = T.StructType().add("tree", "long").add("block", "long").add("path", "binary")
_CHECKED = (
    T.StructType().add("id", "long").add("leaf", "string").add("subroot", "string").add("root", "string")
    .add("proof", T.ArrayType(T.StringType())).add("folded_root", "string").add("verified", "boolean")
)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, ``:`` and the value, or ``-`` if it is null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def combined(digests: list[bytes]) -> bytes:
    """The parent of some nodes: the hash of their digests as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def levels_above(total: int) -> int:
    """How many levels a tree has above its leaves; a lone leaf is its own root."""
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def positions(level: int, index: np.ndarray | int, total: int, levels: int) -> np.ndarray | int:
    """Places in the postorder log of nodes of one level, in a tree of ``total`` leaves cut off above ``levels``.

    When a node is written, every level up to its own holds the nodes over the leaves up to its last one, and every higher level
    the nodes that lie wholly before its first one.
    """
    last = np.minimum((index + 1) * ARITY**level, total)
    before = sum(-(-last // ARITY**k) for k in range(level + 1))
    return before + sum(index // ARITY ** (k - level) for k in range(level + 1, levels + 1)) - 1


def block_log(leaves: list[bytes], levels: int) -> bytes:
    """The digests of a block's nodes in completion order."""
    count = sum(-(-len(leaves) // ARITY**k) for k in range(levels + 1))
    log: list[bytes] = [b""] * count
    nodes = leaves
    for level in range(levels + 1):
        if level:
            nodes = [combined(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        for place, node in zip(positions(level, np.arange(len(nodes)), len(leaves), levels).tolist(), nodes):
            log[place] = node
    return b"".join(log)


def block_size(log: bytes, levels: int) -> int:
    """How many leaves a log of so many levels has."""
    nodes = len(log) // DIGEST
    low, high = 0, nodes
    while low < high:
        middle = (low + high) // 2
        if sum(-(-middle // ARITY**k) for k in range(levels + 1)) < nodes:
            low = middle + 1
        else:
            high = middle
    return low


def block_proofs(log: bytes, leaves: int, levels: int) -> list[bytes]:
    """For every leaf of a block its siblings up to the block's root, level by level, left to right."""
    above = [b""]
    for level in range(levels - 1, -1, -1):
        count = -(-leaves // ARITY**level)
        places = positions(level, np.arange(count), leaves, levels).tolist()
        nodes = [log[p * DIGEST : (p + 1) * DIGEST] for p in places]
        proofs = []
        for i in range(count):
            first = i - i % ARITY
            siblings = b"".join(nodes[j] for j in range(first, min(first + ARITY, count)) if j != i)
            proofs.append(siblings + above[i // ARITY])
        above = proofs
    return above


def folded(leaf: bytes, proof: bytes, steps: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings lead to; a step is the node's place in its run and the run's length."""
    at = 0
    for place, length in steps:
        cut, end = at + place * DIGEST, at + (length - 1) * DIGEST
        leaf = hashlib.sha256((proof[at:cut] + leaf + proof[cut:end]).hex().encode()).digest()
        at = end
    return leaf


def steps_to_root(index: int, total: int) -> list[tuple[int, int]]:
    """(place in the run, length of the run) of a leaf's ancestors, from the leaf up."""
    steps = []
    while total > 1:
        steps.append((index % ARITY, min(ARITY, total - index // ARITY * ARITY)))
        index, total = index // ARITY, -(-total // ARITY)
    return steps


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` (a stored table) with ``place``, the rank from 0 within the group, and ``total``, the group's size.

    Rows are sorted by the group, the order and then all other columns; nulls come first.
    """
    keys = [*group, *order]
    tasks = size_tasks(rows.count(), ROWS_PER_TASK)
    ranged = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys, *[c for c in rows.columns if c not in keys])
    ordered = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    task = F.shiftright("_at", 33)
    # one row per task and group: rows are numbered in a row within a task, so the first number and the count place them all
    runs = ordered.groupBy(task.alias("_task"), *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_task", "_first", *[F.col(c).alias(f"_{c}") for c in group], before.alias("_before"), F.sum("_n").over(whole).alias("total"))
    same = F.shiftright(ordered["_at"], 33) == runs["_task"]
    for c in group:
        same &= ordered[c].eqNullSafe(runs[f"_{c}"])
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return ordered.join(runs, same).select(*rows.columns, place.alias("place"), "total")


@dataclass
class Manifest:
    """The logs of all trees: ``rounds[t]`` has one row per block of the t-th round of builders, ``top`` the same of the tree of groups."""

    rounds: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: str | None
    height: int

    def log(self) -> DataFrame:
        """(tree, position, level, index, digest) of every node of the groups' trees, positions counted within the tree."""
        return _log_rows(self.rounds, self.height)


def build(leaves: DataFrame, name: str = "merkle", height: int = HEIGHT) -> Manifest:
    """The manifest of (group, id, leaf, claim): ``leaf`` is the digest that is built in, ``claim`` the one that ``check`` folds.

    Leaves are ordered by id (nulls first), then by digest, so repeated ids have a defined order; a null group is a group. An
    empty table gives a manifest without nodes and a null root.
    """
    leaves = stored(leaves.select("group", F.col("id").cast("long").alias("id"), F.unhex("leaf").alias("leaf"), F.unhex("claim").alias("claim")), f"{name}-leaves")
    ordered = placed(leaves, ["group"], ["id"], f"{name}-order")
    groups = stored(ordered.where("place = 0").select("group", F.col("total").alias("size")), f"{name}-groups")
    groups = stored(placed(groups, [], ["group"], f"{name}-group-order").withColumnRenamed("place", "tree").withColumnRenamed("total", "trees"), f"{name}-groups")
    numbered = ordered.join(groups.select(F.col("group").alias("_group"), "tree"), F.col("group").eqNullSafe(F.col("_group")))
    rounds = _built(numbered.select("tree", "place", "total", "id", "leaf", "claim"), groups.agg(F.max("size")).first()[0] or 0, name, height)
    roots = _roots(rounds, height).join(groups, "tree")
    subroots = roots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("total"), F.col("tree").alias("id"),
        F.col("node").alias("leaf"), F.col("node").alias("claim"),
    )
    top = _built(subroots, groups.count(), f"{name}-top", height)
    found = _roots(top, height).first()
    return Manifest(rounds, top, groups, found["node"].hex() if found else None, height)


def _built(nodes: DataFrame, largest: int, name: str, height: int) -> list[DataFrame]:
    """The blocks of every round of builders. ``nodes``: (tree, place, total, id, leaf, claim)."""
    rounds: list[DataFrame] = []
    below = 0
    while not rounds or largest > ARITY**height:
        largest = largest if not rounds else -(-largest // ARITY**height)
        blocks = nodes.withColumn("block", F.expr(f"place div {ARITY**height}"))
        rounds.append(stored(blocks.groupBy("tree", "block").applyInArrow(_builder(below, height), _RUN), f"{name}-log-{len(rounds)}"))
        below += height
        # a tree goes on as long as its last round had several blocks
        nodes = rounds[-1].where(F.col("total") > ARITY**below).select(
            "tree", F.col("block").alias("place"), "total", F.lit(None).cast("long").alias("id"), _last("log").alias("leaf"), _last("log").alias("claim")
        )
    return rounds


def _last(log: str) -> Column:
    return F.expr(f"substring({log}, octet_length({log}) - {DIGEST - 1}, {DIGEST})")


def _builder(below: int, height: int):
    def built(block: pa.Table) -> pa.Table:
        order = np.argsort(block.column("place").to_numpy(), kind="stable").tolist()
        leaves, claims, ids = (block.column(c).to_pylist() for c in ("leaf", "claim", "id"))
        total = block.column("total")[0].as_py()
        log = block_log([leaves[i] for i in order], _levels(total, below, height))
        row = [
            [block.column("tree")[0].as_py()], [block.column("block")[0].as_py()], [total], [log],
            [[ids[i] for i in order] if not below else []], [b"".join(claims[i] for i in order) if not below else b""],
        ]
        return pa.Table.from_batches([record_batch(_RUN, row)])

    return built


def _levels(total: int, below: int, height: int) -> int:
    """Levels that a round adds which starts ``below`` levels above the leaves."""
    return min(height, levels_above(total) - below)


def _roots(rounds: list[DataFrame], height: int) -> DataFrame:
    """(tree, node) from the round in which each tree ended."""
    ended = None
    for t, runs in enumerate(rounds):
        last = runs.where((F.col("total") <= ARITY ** (height * (t + 1))) & (F.lit(t == 0) | (F.col("total") > ARITY ** (height * t))))
        last = last.select("tree", _last("log").alias("node"))
        ended = last if ended is None else ended.union(last)
    return ended


def _log_rows(rounds: list[DataFrame], height: int) -> DataFrame:
    schema = T.StructType().add("tree", "long").add("position", "long").add("level", "integer").add("index", "long").add("digest", "string")
    found = None
    for t, runs in enumerate(rounds):

        def rows(batches: Iterator[pa.RecordBatch], below: int = t * height) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, block, total, log in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    levels, full = _levels(total, below, height), levels_above(total)
                    leaves = block_size(log, levels)
                    for level in range(1 if below else 0, levels + 1):
                        inside = np.arange(-(-leaves // ARITY**level))
                        places = positions(level, inside, leaves, levels).tolist()
                        index = block * ARITY ** (height - level) + inside
                        at = positions(below + level, index, total, full)
                        digests = [log[p * DIGEST : (p + 1) * DIGEST].hex() for p in places]
                        yield record_batch(schema, [[tree] * len(places), at, [below + level] * len(places), index, digests])

        part = runs.select("tree", "block", "total", "log").mapInArrow(rows, schema)
        found = part if found is None else found.union(part)
    return found


def _proved(rounds: list[DataFrame], paths: DataFrame, height: int) -> DataFrame:
    """The blocks of the first round with ``path``: the siblings of the block's root, up to the last root.

    ``paths``: (tree, path) of the trees' roots.
    """
    above = None
    for t in range(len(rounds) - 1, -1, -1):
        runs = rounds[t].select("tree", "block", "total", "log", *(["ids", "claims"] if not t else []))
        ends = F.col("total") <= ARITY ** (height * (t + 1))
        known = runs.where(ends).join(paths, "tree")
        if above is not None:
            known = known.unionByName(runs.where(~ends).join(above, ["tree", "block"]))
        if not t:
            return known

        def proved(batches: Iterator[pa.RecordBatch], below: int = t * height) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, block, total, log, path in zip(*(c.to_pylist() for c in batch.columns)):
                    levels = _levels(total, below, height)
                    inside = block_proofs(log, block_size(log, levels), levels)
                    index = block * ARITY**height + np.arange(len(inside))
                    yield record_batch(_PATH, [[tree] * len(inside), index, [p + path for p in inside]])

        above = known.select("tree", "block", "total", "log", "path").mapInArrow(proved, _PATH)


def check(manifest: Manifest) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, proof (siblings from the leaf up to the root), folded_root, verified.

    ``folded_root`` is what the claimed digest and the proof lead to; ``verified`` says whether that is the root.
    """
    height = manifest.height
    trees = manifest.groups.agg(F.max("trees")).first()[0] or 0
    root = bytes.fromhex(manifest.root or "")

    def top_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tree of a group, 0, path): the proofs of the groups' roots in the tree of groups."""
        for batch in batches:
            for block, total, log, path in zip(*(c.to_pylist() for c in batch.columns[1:])):
                levels = _levels(total, 0, height)
                inside = block_proofs(log, block_size(log, levels), levels)
                index = block * ARITY**height + np.arange(len(inside))
                yield record_batch(_PATH, [index, [0] * len(inside), [p + path for p in inside]])

    empty = manifest.top[0].select("tree").distinct().withColumn("path", F.lit(b""))
    tops = _proved(manifest.top, empty, height).select("tree", "block", "total", "log", "path").mapInArrow(top_paths, _PATH)
    paths = stored(tops.join(_roots(manifest.rounds, height), "tree").select("tree", "path", F.col("node").alias("subroot")), "merkle-paths")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in range(batch.num_rows):
                tree, block, total, log, ids, claims, path, subroot = (c[run].as_py() for c in batch.columns)
                levels = _levels(total, 0, height)
                proofs = block_proofs(log, len(ids), levels)
                leaves = positions(0, np.arange(len(ids)), len(ids), levels).tolist()
                upper = steps_to_root(tree, trees)
                rows: list[list] = [[], [], [], []]
                for i, proof in enumerate(proofs):
                    proof += path
                    steps = steps_to_root(block * ARITY**height + i, total) + upper
                    found = folded(claims[i * DIGEST : (i + 1) * DIGEST], proof, steps)
                    digits = proof.hex()
                    values = (log[leaves[i] * DIGEST : (leaves[i] + 1) * DIGEST].hex(), [digits[k : k + 64] for k in range(0, len(digits), 64)], found.hex(), found == root)
                    for column, value in zip(rows, values):
                        column.append(value)
                n = len(ids)
                yield record_batch(_CHECKED, [ids, rows[0], [subroot.hex()] * n, [root.hex()] * n, rows[1], rows[2], rows[3]])

    blocks = _proved(manifest.rounds, paths.select("tree", "path"), height).join(paths.select("tree", "subroot"), "tree")
    return blocks.select("tree", "block", "total", "log", "ids", "claims", "path", "subroot").mapInArrow(checked, _CHECKED)
