"""SimHash near-duplicates: fingerprints joined with themselves over a binary trie.

Fingerprints are sorted, so that a trie node is a stretch of the sorted array.  Pairs of nodes
are traversed together from the top; a pair adds one differing bit whenever its two nodes take
different branches, and is dropped as soon as it exceeds the error budget.  Small node pairs are compared
directly.  The top levels of the traversal are done by Spark: every fingerprint goes to the pairs of top
nodes that are within the budget, and each pair of top nodes is one group.  A group returns at most one
link per fingerprint (a spanning forest of what it found), so links do not grow with the square of a dense
cluster; connectivity is lost nowhere.

Equal fingerprints are one node of the graph, however many documents share them.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; rows
with a null id are placed like others and are never a component's id unless all its ids are null;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from clusterlens.llm import text as tx
from clusterlens.llm.components import components
from clusterlens.llm.staging import column, stage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SUBTRIE = 1 << 18  # fingerprints in a subtrie, about
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the hashes of all word shingles, repeats included."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle)])) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for low in range(0, count, CHUNK):
        ones += np.unpackbits(hashes[low : low + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, text: str, name: str, *, shingle: int, seed: int, drop_text: bool) -> DataFrame:
    """The documents with their fingerprint as a (signed) ``bigint`` column."""
    carried = [c for c in documents.columns if not (drop_text and c == text)]
    schema = T.StructType([*[documents.schema[c] for c in carried], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            values = (fingerprint((x.as_py() or "").encode(), shingle, seed) for x in batch.column(names.index(text)))
            found = np.fromiter(values, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in carried], pa.array(found)], names=schema.names)

    return documents.mapInArrow(tx.frugal(run), schema)


class Forest:
    """Disjoint sets over positions, joined in bulk."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.root[i], self.root[j]
            apart = i != j
            i, j = i[apart], j[apart]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(i, j), np.minimum(i, j))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def near_pairs(values: np.ndarray, first: tuple[int, int], second: tuple[int, int], depth: int, error: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of sorted distinct values that differ in at most ``budget`` bits.

    One value is of the first stretch, the other of the second; each stretch is a trie node at ``depth``,
    and their paths differ in ``error`` bits.  Equal stretches give each pair once.
    """
    node = np.array([[*first, *second, error]], np.int64)
    todo = [(depth, node)]
    while todo:
        depth, nodes = todo.pop()
        if len(nodes) > CHUNK:
            todo += [(depth, nodes[k : k + CHUNK]) for k in range(0, len(nodes), CHUNK)]
            continue
        a, b, c, d, e = nodes.T
        small = (b - a) * (d - c) <= 64
        if small.any():
            sa, sb, sc, sd = a[small], b[small], c[small], d[small]
            width = sd - sc
            sizes = (sb - sa) * width
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            w = np.repeat(width, sizes)
            i, j = np.repeat(sa, sizes) + at // w, np.repeat(sc, sizes) + at % w
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
            near &= (i < j) | (np.repeat(sa, sizes) != np.repeat(sc, sizes))
            yield i[near], j[near]
        a, b, c, d, e = nodes[~small].T
        if not len(a):
            continue
        shift = np.uint64(63 - depth)
        one = np.uint64(1)
        am = np.clip(np.searchsorted(values, ((values[a] >> shift) | one) << shift), a, b)
        cm = np.clip(np.searchsorted(values, ((values[c] >> shift) | one) << shift), c, d)
        same = a == c
        children = [
            np.stack([a, am, c, cm, e], 1),
            np.stack([am, b, cm, d, e], 1),
            np.stack([a, am, cm, d, e + 1], 1),
            np.stack([am, b, c, cm, e + 1], 1)[~same],
        ]
        below = np.concatenate(children)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            todo.append((depth + 1, below))


def links(distinct: DataFrame, count: int, budget: int) -> DataFrame:
    """``u, v``: links that connect all fingerprints (column ``fp``) within the budget of each other."""
    depth = max(int(np.ceil(np.log2(max(1, count) / SUBTRIE))), 4 if count > 4096 else 0)
    masks = [sum(1 << k for k in bits) for r in range(min(budget, depth) + 1) for bits in combinations(range(depth), r)]
    top = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64 - depth)) if depth else F.lit(0).cast("bigint")
    dealt = distinct.select("fp", top.alias("top")).select(
        "fp", "top", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask")
    )
    dealt = dealt.select("fp", F.expr("least(top, top ^ mask)").alias("a"), F.expr("greatest(top, top ^ mask)").alias("b"))

    def join(table: pa.Table) -> pa.Table:
        values = np.sort(table.column("fp").to_numpy().view(np.uint64))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        n = len(values)
        cut = int(np.searchsorted(values, np.uint64(b << (64 - depth)))) if a != b else n
        first, second = ((0, n), (0, n)) if a == b else ((0, cut), (cut, n))
        forest = Forest(n)
        if first[0] < first[1] and second[0] < second[1]:
            for i, j in near_pairs(values, first, second, depth, (a ^ b).bit_count(), budget):
                forest.join(i, j)
        moved = np.flatnonzero(forest.root != np.arange(n))
        signed = values.view(np.int64)
        return pa.table({"u": signed[moved], "v": signed[forest.root[moved]]})

    return dealt.groupBy("a", "b").applyInArrow(tx.frugal(join), "u bigint, v bigint")


def _classes(rows: DataFrame, budget: int) -> DataFrame:
    """``fp, class``: the class of each fingerprint, for all fingerprints in ``rows``."""
    distinct = stage(rows.select("fp").distinct(), "fingerprints")
    stars = components(links(distinct, distinct.count(), budget))
    return distinct.join(stars, distinct.fp == stars.node, "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """Per document: id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id it is linked to)."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stage(fingerprints(rows, "text", "fp", shingle=shingle, seed=seed, drop_text=True), "fingerprints")
    classes = _classes(rows, budget)
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(smallest, "fp").select("fp", "class", "least")
    ids = named.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = stage(named.select("fp", "class").join(ids, "class").select("fp", "component_id"), "components")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id (null last).

    Of rows with one id, that of the smallest digest of its text stays, then that of the smallest digest of its
    other columns; of rows equal in everything, one.  The documents' columns travel as one struct, so
    they may have any names.
    """
    names = documents.columns
    rest = [column(c) for c in names if c not in (doc_id, text)]
    digests = [F.sha2(column(text).cast("string"), 256), F.sha2(F.to_json(F.struct(*rest)) if rest else F.lit(""), 256)]
    key = F.concat_ws("|", column(doc_id).cast("string"), *digests)
    first = F.struct(column(doc_id).isNull().alias("none"), column(doc_id).alias("id"), key.alias("key"))
    rows = documents.select(first.alias("o"), column(text).alias("text"))
    rows = stage(fingerprints(rows, "text", "fp", shingle=shingle, seed=seed, drop_text=True), "fingerprints")
    chosen = rows.groupBy("fp").agg(F.min("o").alias("o")).join(_classes(rows, budget), "fp").groupBy("class").agg(F.min("o").alias("o"))
    keyed = documents.select(F.struct(*[column(c) for c in names]).alias("row"), key.alias("key"))
    kept = keyed.join(chosen.select(F.col("o.key").alias("key")), "key", "left_semi")
    # Rows of one key are equal in all columns.
    return kept.dropDuplicates(["key"]).select("row.*")
