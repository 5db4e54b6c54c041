"""Hard negatives from an exact search in a multiway hyperplane tree (a geometric near-neighbour access tree).

Vectors are scaled and floored to integers; a score is the integer inner product. One added coordinate puts all rows on
a sphere, where a score is a distance to the query: a window of scores is an annulus around it. Every inner node has
up to FANOUT split points, and a row goes to the child of the nearest one. For each pair of siblings the node stores
the least and greatest distance from one's split point to the rows below the other. A child is left out where one of
these ranges misses what the triangle inequality allows for the window. Leaves that remain are scanned exactly.

The split points come from a bounded sample of rows; every row is routed to a leaf, the ranges cover every row, and
leaves of any size are scanned in blocks, so results are those of a scan of the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import discard, stash

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score lies within these percentages of the positive's
FANOUT, LEAF = 16, 1024
SAMPLE = (32_768, 1 << 22)  # rows, and numbers in all, that the split points are chosen from
BLOCK = 1024  # rows and queries that meet at once
PROBES = 2  # leaves looked at first, which narrow the windows for all others
OPEN = 1 << 60
_SLACK = 1e-6  # of the radius: distances are rounded, so ranges are widened by this


def _floored(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Integer components as bytes; NULL where a component is missing or not finite."""
    for b in batches:
        out = []
        for v in b.column(0).to_pylist():
            x = np.array([math.nan if c is None else c for c in v], np.float64) if v is not None else np.array([math.nan])
            if not np.isfinite(x).all():
                out.append(None)
                continue
            x = np.floor(scale * np.r_[x, np.zeros(dim - len(x))])
            if np.abs(x).max(initial=0) >= 2**31:
                raise ValueError("a component does not fit in 32 bits after scaling")
            out.append(x.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.binary())], names=[*b.schema.names[1:], "q"])


def _ints(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dim)


@dataclass
class Node:
    points: np.ndarray  # split points on the sphere
    below: list[int]  # per child the number of an inner node, or -1 - leaf
    low: np.ndarray = field(init=False)  # low[i, j]: least distance from split point i to a row below child j
    high: np.ndarray = field(init=False)

    def __post_init__(self):
        m = len(self.below)
        self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)


class Tree:
    """Split points, children and sibling ranges; ``radius`` is the greatest norm of all rows."""

    def __init__(self, sample: np.ndarray, rows: int, radius: float):
        self.radius, self.dim = radius, sample.shape[1]
        self.nodes: list[Node] = []
        self.paths: list[list[tuple[int, int]]] = []  # per leaf the nodes and children that lead to it
        self.rng = np.random.default_rng(3)
        self.root = self._grown(self.lifted(sample), rows / max(1, len(sample)), [])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that gives all of them the same norm."""
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0))]

    def _grown(self, x: np.ndarray, weight: float, path: list[tuple[int, int]]) -> int:
        points = x[:0]
        if len(x) >= 2 * FANOUT and len(x) * weight > LEAF:
            points = self._spread(x, min(FANOUT, max(2, math.ceil(len(x) * weight / LEAF))))
        if len(points) < 2:
            self.paths.append(path)
            return -len(self.paths)
        number, node = len(self.nodes), Node(points, [0] * len(points))
        self.nodes.append(node)
        nearest = distances(x, points).argmin(axis=1)
        node.below = [self._grown(x[nearest == j], weight, [*path, (number, j)]) for j in range(len(points))]
        return number

    def _spread(self, x: np.ndarray, m: int) -> np.ndarray:
        """Split points far from each other, out of three times as many random rows."""
        pool = x[self.rng.choice(len(x), min(len(x), 3 * m), replace=False)]
        taken, far = [0], distances(pool, pool[:1])[:, 0]
        while len(taken) < m and far.max() > _SLACK * max(self.radius, 1):
            taken.append(int(far.argmax()))
            far = np.minimum(far, distances(pool, pool[taken[-1:]])[:, 0])
        return pool[taken]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of integers."""
        x, out = self.lifted(x), np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            number, rows = todo.pop()
            if number < 0:
                out[rows] = -1 - number
            elif len(rows):
                node = self.nodes[number]
                nearest = distances(x[rows], node.points).argmin(axis=1)
                todo += [(node.below[j], rows[nearest == j]) for j in range(len(node.below))]
        return out

    def ranges(self, leaf: int, x: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, i, j, least, greatest) over the rows of one leaf."""
        x = self.lifted(x)
        for number, j in self.paths[leaf]:
            d = distances(x, self.nodes[number].points)
            for i in range(d.shape[1]):
                yield number, i, j, float(d[:, i].min()), float(d[:, i].max())

    def probes(self, q: np.ndarray, count: int) -> list[int]:
        """Leaves whose split points lie nearest along the way down."""
        q, out, todo = np.r_[q, 0.0], [], [(0.0, self.root)]
        while todo and len(out) < count:
            todo.sort()
            _, number = todo.pop(0)
            if number < 0:
                out.append(-1 - number)
                continue
            node = self.nodes[number]
            todo += zip(distances(q[None], node.points)[0].tolist(), node.below, strict=True)
        return out

    def reached(self, q: np.ndarray, windows: list[tuple[int, int]]) -> list[int]:
        """Leaves that may hold a row whose score lies in one of the windows."""
        if not windows:
            return []
        square, slack = float(q @ q), _SLACK * (self.radius + math.sqrt(float(q @ q))) + 1e-9
        ends = np.array(windows, np.float64)
        near = np.sqrt(np.maximum(square + self.radius**2 - 2 * ends[:, 1], 0))[:, None]  # radii of the annuli
        far = np.sqrt(np.maximum(square + self.radius**2 - 2 * ends[:, 0], 0))[:, None]
        q, out, todo = np.r_[q, 0.0], [], [self.root]
        while todo:
            number = todo.pop()
            if number < 0:
                out.append(-1 - number)
                continue
            node = self.nodes[number]
            at = distances(q[None], node.points)
            least = np.maximum(at - far, near - at) - slack  # by window and split point
            most = at + far + slack
            alive = ((node.high[None] >= least[:, :, None]) & (node.low[None] <= most[:, :, None])).all(axis=1).any(axis=0)
            todo += [node.below[j] for j in np.flatnonzero(alive)]
        return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Index:
    """Rows (uid, id, label, q, leaf, block), blocks per leaf, and the tree."""

    rows: DataFrame
    blocks: DataFrame
    tree: Tree
    exact: np.dtype  # in which inner products are exact


def build(known: DataFrame, dim: int) -> Index:
    """Index rows (uid, id, label, q)."""
    def norms(batches):
        for b in batches:
            x = _ints(b.column(0).to_pylist(), dim).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "norm": [float((x * x).sum(axis=1).max(initial=0))], "top": [float(np.abs(x).max(initial=0))]})

    size = known.select("q").mapInArrow(norms, "n long, norm double, top double").agg(F.sum("n"), F.max("norm"), F.max("top")).first()
    rows, norm, top = size[0] or 0, size[1] or 0.0, size[2] or 0.0
    if dim * top * top >= 2**55:
        raise ValueError("scores do not fit in 55 bits")
    exact = np.dtype(np.float64 if dim * top * top < 2**53 else np.int64)
    share = min(1.0, min(SAMPLE[0], SAMPLE[1] // max(1, dim)) / max(1, rows))
    picked = known.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else known
    tree = Tree(_ints([r.q for r in picked.select("uid", "q").orderBy("uid").collect()], dim), rows, math.sqrt(norm))

    def routed(batches):
        for b in batches:
            leaf = tree.leaf_of(_ints(b.column(3).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    placed = stash(known.select("uid", "id", "label", "q").mapInArrow(routed, "uid long, id long, label string, q binary, leaf int"), "leaves")

    def ranged(batches):
        found: dict[tuple, tuple] = {}
        for b in batches:
            leaf, x = b.column(0).to_numpy(), _ints(b.column(1).to_pylist(), dim)
            for one in np.unique(leaf):
                for n, i, j, lo, hi in tree.ranges(int(one), x[leaf == one]):
                    old = found.get((n, i, j), (lo, hi))
                    found[n, i, j] = min(lo, old[0]), max(hi, old[1])
        out = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in out] for k, c in enumerate("nijlh")}, pa.schema([("n", "int32"), ("i", "int32"), ("j", "int32"), ("l", "float64"), ("h", "float64")]))

    spans = placed.select("leaf", "q").mapInArrow(ranged, "n int, i int, j int, l double, h double")
    for r in spans.groupBy("n", "i", "j").agg(F.min("l").alias("l"), F.max("h").alias("h")).collect():  # bounded by the tree
        tree.nodes[r.n].low[r.i, r.j], tree.nodes[r.n].high[r.i, r.j] = r.l, r.h
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return Index(placed, blocks, tree, exact)


def _visits(queries: DataFrame, tree: Tree, probe: bool) -> DataFrame:
    """One row per query and leaf to look at; queries are (query, uid, label, q, windows)."""
    dim = tree.dim

    def leaves(batches):
        for b in batches:
            out = []
            for q, windows in zip(_ints(b.column(3).to_pylist(), dim), b.column(4).to_pylist(), strict=True):
                ends = [(w["lo"], w["hi"]) for w in windows if w["lo"] <= w["hi"]]
                x = q.astype(np.float64)
                out.append((tree.probes(x, PROBES) if ends else []) if probe else tree.reached(x, ends))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "leaf"])

    found = queries.select("query", "uid", "label", "q", "windows").mapInArrow(leaves, _QUERY + ", leaf array<int>")
    return found.withColumn("leaf", F.explode("leaf"))


_QUERY = "query long, uid long, label string, q binary, windows array<struct<lo: long, hi: long>>"


class _Meeting:
    """Rows of one block and the queries that look at it."""

    def __init__(self, members: list[tuple], dim: int, exact: np.dtype):
        rows, asks = [m for m in members if m[3] == 0], [m for m in members if m[3] == 1]
        self.uid, self.query = np.array([m[5] for m in rows], np.int64), np.array([m[4] for m in asks], np.int64)
        self.own = np.array([m[5] for m in asks], np.int64)
        self.id = np.array([m[6] or 0 for m in rows], np.int64)
        self.unnamed = np.array([m[6] is None for m in rows], bool)
        names = {label: k for k, label in enumerate({m[7] for m in members})}
        self.label, self.wanted = (np.array([names[m[7]] for m in part], np.int64) for part in (rows, asks))
        self.x, self.q = (_ints([m[8] for m in part], dim).astype(exact) for part in (rows, asks))
        self.windows = [[(w["lo"], w["hi"]) for w in m[9]] for m in asks]

    def best(self, count: int, same: bool) -> list[tuple[np.ndarray, ...]]:
        """The first ``count`` rows per query and window: arrays of query, window, score and row."""
        out = []
        if not len(self.uid):
            return out
        for lo in range(0, len(self.query), 128):
            part = range(lo, min(lo + 128, len(self.query)))
            scores = np.rint(self.q[lo : part.stop] @ self.x.T).astype(np.int64)
            fits = (self.wanted[lo : part.stop, None] == self.label) == same
            fits &= self.own[lo : part.stop, None] != self.uid
            for w in range(max(len(self.windows[k]) for k in part)):
                ends = np.array([self.windows[k][w] if w < len(self.windows[k]) else (1, 0) for k in part], np.int64)
                ok = fits & (scores >= ends[:, :1]) & (scores <= ends[:, 1:])
                held = np.where(ok, scores, -OPEN * 2)
                if held.shape[1] > count:
                    last = np.partition(held, held.shape[1] - count, axis=1)[:, -count]
                    ok &= held >= last[:, None]
                k, r = np.nonzero(ok)
                order = np.lexsort((self.uid[r], self.id[r], self.unnamed[r], -scores[k, r], k))
                k, r = k[order], r[order]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
                rank = np.arange(len(k)) - np.repeat(first, np.diff(np.r_[first, len(k)]))
                k, r = k[rank < count], r[rank < count]
                out.append((self.query[lo + k], np.full(len(k), w), scores[k, r], r))
        return out


def _scanned(index: Index, visits: DataFrame, count: int, same: bool) -> DataFrame:
    """Rows (query, window, score, id, uid): the best of each block for each query that looks at it."""
    dim, exact = index.tree.dim, index.exact
    chunks = visits.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    sizes = index.blocks.join(chunks, "leaf")  # one row per leaf of the tree, which SAMPLE bounds
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    none = F.lit(None).cast("array<struct<lo: long, hi: long>>")
    rows = index.rows.join(F.broadcast(sizes), "leaf").select(
        "leaf", own("uid", "blocks").alias("block"), upto("chunks").alias("chunk"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("query"), "uid", "id", "label", "q", none.alias("windows")
    )
    asks = visits.join(F.broadcast(sizes), "leaf").select(
        "leaf", upto("blocks").alias("block"), own("query", "chunks").alias("chunk"), F.lit(1).alias("side"), "query", "uid", F.lit(None).cast("long").alias("id"), "label", "q", "windows"
    )

    def done(members):
        found = []
        if members and members[0][3] == 0 and members[-1][3] == 1:
            one = _Meeting(members, dim, exact)
            found = [(q, w, s, one.id[r], one.unnamed[r], one.uid[r]) for q, w, s, r in one.best(count, same)]
        query, window, score, ids, unnamed, uid = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(window.astype(np.int32)), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(uid, pa.int64())],
            names=["query", "window", "score", "id", "uid"],
        )

    def met(batches):
        at, members = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != at:
                    if members:
                        yield done(members)
                    at, members = row[:3], []
                members.append(row)
        yield done(members)

    both = rows.union(asks).repartition("leaf", "block", "chunk").sortWithinPartitions("leaf", "block", "chunk", "side")
    return both.mapInArrow(met, "query long, window int, score long, id long, uid long")


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def search(index: Index, queries: DataFrame, count: int, same: bool) -> DataFrame:
    """Rows (query, window, rank, id, uid, score): the first ``count`` rows in each window of each query.

    ``same`` asks for rows of the query's own label, otherwise of any other one. The row whose uid is the query's is
    left out. A first look into PROBES leaves gives scores that the wanted rows reach at least; with windows cut there,
    the tree names the leaves that can matter.
    """
    looked = stash(_visits(queries, index.tree, probe=True), "probes")
    seen = _first(_scanned(index, looked, count, same), count).where(F.col("rank") == count)
    floors = seen.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_floor"))  # one entry per window
    cut = F.transform(
        "windows", lambda w, i: F.struct(F.greatest(w["lo"], F.coalesce(F.try_element_at("_floor", i), w["lo"])).alias("lo"), w["hi"].alias("hi"))
    )
    narrowed = queries.join(floors, "query", "left").withColumn("windows", cut).drop("_floor")
    visits = stash(_visits(narrowed, index.tree, probe=False), "visits")
    found = stash(_first(_scanned(index, visits, count, same), count), "found")
    discard(looked)
    discard(visits)
    return found


def hard_negatives(
    df: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x becomes floor(scale * x). For each row of ``df`` where ``anchors`` holds, the positives are its first
    other rows of the same label; for each of them come the first rows of another label whose score lies between
    ``low`` and ``high`` percent of the positive's. Higher scores come first, then smaller ids; NULL ids come last, then
    the order of storage. Rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part. Shorter vectors count as
    padded with zeros, empty ones as zero. Repeated rows are rows of their own, as anchors too. ``vec_id`` is read as a
    long, ``label`` by its text; other columns play no part. An empty table gives an empty result. Components that do
    not fit in 32 bits after scaling, and scores beyond 55 bits, raise an error.
    """
    taken = df.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).select(
        F.col(f"`{vector}`").alias("v"),
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    dim = df.agg(F.max(F.size(f"`{vector}`"))).first()[0] or 0
    dim = max(dim, 1)
    fields = "uid long, id long, label string, anchor boolean, q binary"
    known = stash(taken.mapInArrow(lambda batches: _floored(batches, dim, scale), fields).where("q is not null"), "integers")
    index = build(known, dim)
    whole = F.array(F.struct(F.lit(-OPEN).alias("lo"), F.lit(OPEN).alias("hi")))
    asked = known.where("anchor").select(F.col("uid").alias("query"), "uid", "label", "q", whole.alias("windows"))
    near = search(index, asked, positives, same=True)
    floor_div = lambda x, n: F.expr(f"({x} - pmod({x}, {n})) div {n}")
    ends = F.struct(
        F.col("rank"), (-floor_div(f"(-{low} * score)", 100)).alias("lo"), floor_div(f"({high} * score)", 100).alias("hi"), F.col("id"), F.col("score")
    )
    paired = stash(near.groupBy("query").agg(F.sort_array(F.collect_list(ends)).alias("positives")), "positives")  # a few per query
    windows = F.transform("positives", lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi")))
    asked = known.join(paired, known.uid == paired.query).select("query", "uid", "label", "q", windows.alias("windows"))
    far = search(index, asked, negatives, same=False)
    names = known.where("anchor").select(F.col("uid").alias("query"), F.col("id").alias("anchor_id"))
    positive = F.element_at("positives", F.col("window") + 1)
    return (
        far.join(paired, "query")
        .join(names, "query")
        .select(
            "anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
            positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
        )
    )
