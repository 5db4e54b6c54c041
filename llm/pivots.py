"""Near-duplicate embeddings by a pivot-permutation index.

Each vector is described by its NEAREST reference points in order of similarity (the head of its pivot permutation).
Inverted lists hold, per pivot, the vectors that name it. Two vectors are candidates when they share at least SHARED
pivots; they are looked at in the list of their first shared pivot only and confirmed by cosine in double precision.
Long lists are compared block by block, so that a list of any length is spread over tasks; tasks return how many
links each vector has and enough links to connect what is connected, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, stash

COSINE = 0.95
NEAREST, SHARED = 12, 2
PIVOTS = (64, 4096)  # twice the root of the number of vectors, within these bounds
BLOCK = 1024


def _usable(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Unit directions as bytes, with a hash of the components; NULL for vectors that link with nothing."""
    for b in batches:
        out, cids = [], []
        for v in b.column(1).to_pylist():
            x = np.array([math.nan if c is None else c for c in v or []], np.float64)
            top = np.abs(x).max(initial=0.0)
            if not (0 < top < math.inf):
                out.append(None), cids.append(None)
                continue
            x = np.r_[x, np.zeros(dim - len(x))]
            cids.append(int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True))
            out.append((x / top).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "cid", "vector"])


def _matrix(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reference_points(classes: DataFrame, n: int) -> np.ndarray:
    """The pivots: a sample of distinct vectors by the order of their hashes, of a size bounded by PIVOTS."""
    count = min(max(PIVOTS[0], round(2 * math.sqrt(n))), PIVOTS[1])
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(count).select("vector").collect()
    x = np.array([np.frombuffer(r.vector, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (cid, copies, vector, near): the pivots nearest to each vector, nearest first, ties by number."""
    take = min(NEAREST, len(pivots))

    def describe(batches):
        for b in batches:
            if b.num_rows:
                sims = np.round(_matrix(b.column(2)) @ pivots.T, 12)
                near = np.argsort(-sims, axis=1, kind="stable")[:, :take].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[*b.schema.names, "near"])

    return classes.mapInArrow(describe, "cid long, copies long, vector binary, near array<int>")


class _List:
    """Two blocks of one inverted list."""

    def __init__(self, pivot: int, x: int, y: int, rows: list[tuple]):
        rows.sort(key=lambda r: (r[0] != x, r[1]))
        self.pivot, self.same = pivot, x == y
        self.first = sum(r[0] == x for r in rows)
        self.cids = np.array([r[1] for r in rows], np.int64)
        self.copies = np.array([r[2] for r in rows], np.int64)
        v = np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(len(rows), -1)
        self.v, self.norm = v, np.linalg.norm(v, axis=1)
        near = np.array([r[4] for r in rows], np.int64)
        names, at = np.unique(near, return_inverse=True)
        self.named = np.zeros((len(rows), len(names)), np.float32)
        self.named[np.arange(len(rows))[:, None], at.reshape(near.shape)] = 1
        self.before = self.named[:, names < pivot]

    def links(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        n = len(self.cids)
        counts, label, joined = np.zeros(n, np.int64), np.arange(n), []
        second = np.arange(0 if self.same else self.first, n)
        for lo in range(0, self.first, 256):
            rows = np.arange(lo, min(lo + 256, self.first))
            near = (self.named[rows] @ self.named[second].T >= min(SHARED, self.named.shape[1])) & (self.before[rows] @ self.before[second].T == 0)
            if self.same:
                near &= rows[:, None] < second[None]
            i, j = np.nonzero(near)
            i, j = rows[i], second[j]
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                cos = np.einsum("ij,ij->i", self.v[a], self.v[b]) / (self.norm[a] * self.norm[b])
                a, b = a[cos >= COSINE], b[cos >= COSINE]
                np.add.at(counts, a, self.copies[b])
                np.add.at(counts, b, self.copies[a])
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    while label[p] != p:
                        label[p] = label[label[p]]
                        p = label[p]
                    while label[q] != q:
                        label[q] = label[label[q]]
                        q = label[q]
                    if p != q:
                        label[max(p, q)] = min(p, q)
                        joined.append((int(self.cids[p]), int(self.cids[q])))
        return counts, joined


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(at, rows):
        out = []
        if at and len(rows) > 1:
            one = _List(*at, rows)
            counts, joined = one.links()
            out = [(int(one.cids[k]), None, int(counts[k])) for k in np.flatnonzero(counts)] + [(a, b, None) for a, b in joined]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "n"])

    at, rows = None, []
    for batch in batches:
        for pivot, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (pivot, x, y) != at:
                yield done(at, rows)
                at, rows = (pivot, x, y), []
            rows.append(tuple(row))
    yield done(at, rows)


def list_links(index: DataFrame) -> DataFrame:
    """Rows (a, b, n): n links of vector a found in one place (b is NULL), or a link (a, b) that joins two components."""
    posts = index.withColumn("pivot", F.explode("near"))
    blocks = posts.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")),
    )
    dealt = posts.join(F.broadcast(blocks), "pivot").withColumn("block", own).withColumn("pair", F.explode(pairs))
    rows = dealt.select("pivot", "pair.x", "pair.y", "block", "cid", "copies", "vector", "near")
    return rows.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y").mapInArrow(_compared, "a long, b long, n long")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``df``.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing and are their own
    component. Shorter vectors count as padded with zeros. Equal vectors are compared once and count as often as they
    occur. NULL ids take part but are no component's smallest id unless all are NULL; kept is false for them. An empty
    table gives an empty result; other columns of ``df`` play no part.
    """
    kind = dict(df.dtypes)[vec_id]
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    known = stash(rows.mapInArrow(lambda batches: _usable(batches, dim), f"vec_id {kind}, cid long, vector binary"), "vectors")
    classes = stash(
        known.where("cid is not null").groupBy("cid").agg(F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes"
    )
    n = classes.count()
    alone = known.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    found = stash(list_links(described(classes, reference_points(classes, n))), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    every = classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    labels = components(found.where("b is not null").select("a", "b").union(every)).toDF("cid", "root")
    least = known.join(labels, "cid").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    summary = classes.select("cid", "copies").join(counts, "cid", "left").join(labels, "cid").join(least, "root")
    linked = known.where("cid is not null").select("vec_id", "cid").join(summary, "cid").select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
