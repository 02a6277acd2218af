"""Merkle manifest of a dataset, with one tree per group and a tree over the groups.

Every row is a leaf; per group the leaves ascend by id, and every two consecutive nodes become
their digest until one is left. The roots of the groups, ordered by group, form a tree in turn.

Time-forward processing: nodes carry a label, and a node's label is larger than its children's.
Digests are sent to the label of the parent through a priority queue, so that a sweep in label
order finds each parent's children at the head of the queue when it gets there. A second sweep
in reverse order sends to each node the siblings on its way to the root, the suffix of every
proof below it. The external part of the queue is Spark's sort: leaves are put in order by a
range shuffle, runs of ``1 << LEVELS`` leaves (a parameter) are swept in a task each, and what they send beyond
their run is grouped by the label of the receiving run for the next round. There are
log(n) / LEVELS rounds; a round holds a ``1 << LEVELS``-th of the nodes of the one before.

Rows of one id are ordered by their digest, equal rows by any order, which changes no digest; rows
without an id come first. A null field is a ``-`` in its leaf, a null group a group of its own
before all others. An empty table has no leaf and no row. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordering import with_position
from pulsegrid.plans.staging import stage

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = tuple[str, ...]


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts, concatenated."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of a row: ``-`` for a null value, else its UTF-8 length, a colon and the value."""
    texts = [v.cast("string") for v in values]
    named = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*named).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def upward(leaves: Sequence[str], levels: int) -> list[list[str]]:
    """Digests of all nodes, level by level, of a tree cut off ``levels`` above its leaves.

    A label is the last leaf below a node, then its level: everything below a node comes before
    it, and at most a few messages per level wait in the queue at any time."""
    last = len(leaves) - 1
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, str]] = []  # label of the receiver, place among its children, digest

    def send(level: int, value: str) -> None:
        at = len(nodes[level])
        nodes[level].append(value)
        if level < levels:
            end = min((((at >> 1) + 1) << (level + 1)) - 1, last)
            heapq.heappush(queue, (end, level + 1, at & 1, value))

    for i, leaf in enumerate(leaves):
        send(0, leaf)
        while queue and queue[0][0] <= i:
            label, parts = queue[0][:2], []
            while queue and queue[0][:2] == label:
                parts.append(heapq.heappop(queue)[3])
            send(label[1], digest(*parts))
    return nodes


def downward(nodes: list[list[str]], above: Path) -> list[Path]:
    """Siblings of every leaf up to the root, given those of the tree's top node: ``L`` or ``R``
    and the digest, or ``N`` where a node is alone. The sweep of ``upward`` in reverse."""
    top, last = len(nodes) - 1, len(nodes[0]) - 1
    paths: list[Path] = [()] * (last + 1)
    queue: list[tuple[int, int, int, Path]] = [(-last, -top, 0, above)]
    while queue:
        _, level, at, path = heapq.heappop(queue)
        if level == 0:
            paths[at] = path
            continue
        below = nodes[-level - 1]
        children = range(2 * at, min(2 * at + 2, len(below)))
        for c in children:
            step = "N" if len(children) == 1 else f"R{below[c + 1]}" if c % 2 == 0 else f"L{below[c - 1]}"
            end = min(((c + 1) << (-level - 1)) - 1, last)
            heapq.heappush(queue, (-end, level + 1, c, (step, *path)))
    return paths


def fold(leaf: str, path: Path) -> str:
    """Root that a leaf and its siblings lead to."""
    for step in path:
        side, other = step[0], step[1:]
        leaf = digest(leaf) if side == "N" else digest(leaf, other) if side == "R" else digest(other, leaf)
    return leaf


_NODE = "tree string, pos long, total long, digest string"
_SEED = "tree string, pos long, path array<string>, roots array<string>"


def _runs(nodes: DataFrame, most: int):
    return nodes.groupBy("tree", F.shiftright("pos", most).alias("run"))


def _raise(most: int):
    """A run of nodes to the one node above it."""

    def run_up(key: tuple[pa.Scalar, ...], run: pa.Table) -> pa.Table:
        run = run.sort_by("pos")
        total = run.column("total")[0].as_py()
        levels = min(most, height(total))
        top = upward(run.column("digest").to_pylist(), levels)[levels][0]
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()], pa.string()),
                "pos": pa.array([key[1].as_py()], pa.int64()),
                "total": pa.array([-(-total >> most)], pa.int64()),
                "digest": [top],
            }
        )

    return run_up


def _spread(run: pa.Table, seed: pa.Table, most: int) -> tuple[pa.Table, list[Path], list[str]]:
    run = run.sort_by("pos")
    levels = min(most, height(run.column("total")[0].as_py()))
    nodes = upward(run.column("digest").to_pylist(), levels)
    return run, downward(nodes, tuple(seed.column("path")[0].as_py())), seed.column("roots")[0].as_py()


def _lower(most: int):
    """A run of nodes and the siblings above it to the siblings of each node."""

    def run_down(key: tuple[pa.Scalar, ...], run: pa.Table, seed: pa.Table) -> pa.Table:
        run, paths, roots = _spread(run, seed, most)
        return pa.table(
            {
                "tree": run.column("tree"),
                "pos": run.column("pos"),
                "path": pa.array([list(p) for p in paths], pa.list_(pa.string())),
                "roots": pa.array([roots] * len(paths), pa.list_(pa.string())),
            }
        )

    return run_down


def _prove(most: int):
    """A run of leaves and the siblings above it to the leaves' proofs."""

    def run_down(key: tuple[pa.Scalar, ...], run: pa.Table, seed: pa.Table) -> pa.Table:
        run, paths, (subroot, root) = _spread(run, seed, most)
        leaves, claims = run.column("digest").to_pylist(), run.column("claim").to_pylist()
        folded = [fold(c, p) for c, p in zip(claims, paths)]
        return pa.table(
            {
                "id": run.column("id"),
                "leaf": leaves,
                "subroot": [subroot] * len(leaves),
                "root": [root] * len(leaves),
                "proof_sha256": [digest(*(s[1:] for s in p)) for p in paths],
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }
        )

    return run_down


def _rounds(nodes: DataFrame, most: int) -> Iterator[DataFrame]:
    """The nodes at the foot of each round, and at last the roots."""
    largest = nodes.agg(F.max("total")).first()[0] or 1
    yield nodes
    for _ in range(max(1, -(-height(largest) // most))):
        runs = _runs(nodes.select("tree", "pos", "total", "digest"), most)
        nodes = stage(runs.applyInArrow(_raise(most), _NODE), "merkle-nodes")
        yield nodes


def _descend(below: DataFrame, seeds: DataFrame, send, most: int, schema: str) -> DataFrame:
    return _runs(below, most).cogroup(seeds.groupBy("tree", "pos")).applyInArrow(send(most), schema)


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proof of every leaf. ``leaves`` has the columns id, tree (a group as a non-null string that
    sorts like the group), leaf, claim (the digest to verify: of the row as it is now).

    Returns id, leaf, subroot (root of the group's tree), root, proof_sha256 (digest of the
    siblings from the leaf to the root), folded_root (from the claim and the siblings), verified."""
    id_type = leaves.schema["id"].dataType.simpleString()
    # A number per row splits equal rows; the table is written, so that it stays.
    leaves = stage(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    placed = with_position(leaves, ["tree"], ["id", "leaf", "tie"], "pos", "total")
    placed = stage(placed.select("id", "tree", "pos", "total", F.col("leaf").alias("digest"), "claim"), "merkle-placed")
    *lower, subroots = _rounds(placed, levels)
    ranked = subroots.select(F.lit("").alias("all"), "tree", F.col("digest").alias("subroot"))
    ranked = with_position(ranked, ["all"], ["tree"], "pos", "total")
    ranked = stage(ranked.select(F.col("tree").alias("group"), F.col("all").alias("tree"), "pos", "total",
                                 F.col("subroot").alias("digest")), "merkle-groups")
    *upper, root = _rounds(ranked, levels)
    # Downwards: the root has no siblings; a subroot's siblings start the ways into its group.
    nothing = F.array().cast("array<string>")
    seeds = root.select("tree", "pos", nothing.alias("path"), F.array("digest").alias("roots"))
    for nodes in reversed(upper):
        seeds = stage(_descend(nodes.select("tree", "pos", "total", "digest"), seeds, _lower, levels, _SEED), "merkle-ways")
    groups = ranked.select(F.col("group").alias("tree"), "pos", F.col("digest").alias("subroot"))
    seeds = groups.join(seeds.select("pos", "path", "roots"), "pos")
    seeds = seeds.select("tree", F.lit(0).cast("long").alias("pos"), "path",
                         F.concat(F.array("subroot"), "roots").alias("roots"))
    for nodes in reversed(lower[1:]):
        seeds = stage(_descend(nodes, seeds, _lower, levels, _SEED), "merkle-ways")
    proof = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _descend(lower[0], seeds, _prove, levels, proof)


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of a document table, a tree per language. Where ``tampered`` holds, the claim is the
    digest of the row with one more in n_chars; a null count stays null."""
    values = [F.col(c) for c in FIELDS]
    leaf = leaf_of(values)
    raised = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    claim = leaf if tampered is None else F.when(tampered, leaf_of(raised)).otherwise(leaf)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select(F.col("doc_id").alias("id"), tree.alias("tree"), leaf.alias("leaf"), claim.alias("claim"))
