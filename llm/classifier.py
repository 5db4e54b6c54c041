"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every hashed word has a sparse random index vector. A word's vector is the sum of the index vectors of the words
around it in the training sample. A document's features are the mean of its word vectors, the mean of the index
vectors of its word shapes, and two lengths. The network's logit is divided by a temperature fitted on labelled rows
that the network has not seen, so that scores are calibrated probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import WORDS

BUCKETS = 1 << 14  # hashed words with a vector each
DIM, SHAPE_DIM, NONZERO = 64, 32, 8
BLOCK = 256  # rows of the vector table that are summed together
SAMPLE = 20_000  # labelled documents the model is fitted on, at most
SAMPLE_CHUNKS = 32  # tasks over the sample
HIDDEN, EPOCHS, STEP, BATCH, SEED = 32, 40, 0.01, 256, 5
_RUNS = re.compile(r"(.)\1+")
_MEMO = 1 << 19

_seen: dict[str, tuple[int, int]] = {}


def _shape(word: str) -> str:
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:64]))


def _places(word: str) -> tuple[int, int]:
    """Hashed places of a word and of its shape."""
    got = _seen.get(word)
    if got is None:
        if len(_seen) >= _MEMO:
            _seen.clear()
        got = (
            crc32(word.lower().encode("utf-8", "replace")) % BUCKETS,
            crc32(_shape(word).encode("utf-8", "replace"), 1) % BUCKETS,
        )
        if len(word) <= 64:
            _seen[word] = got
    return got


def index_vectors(dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors, one per hashed place."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, dim), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, dim, BUCKETS)] = rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over the texts of a task, in blocks of rows."""
    index, total = index_vectors(DIM, SEED), np.zeros((BUCKETS, DIM), np.float64)
    for batch in batches:
        pairs = []
        for text in batch.column(0):
            at = np.array([_places(w)[0] for w in WORDS.findall(text.as_py() or "")], np.int64)
            for k in (1, 2):
                pairs += [at[k:] * BUCKETS + at[:-k], at[:-k] * BUCKETS + at[k:]]
        codes = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        if len(codes):
            codes, n = np.unique(codes, return_counts=True)
            word, near = codes // BUCKETS, codes % BUCKETS
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            for lo in range(0, len(starts), 4096):
                s = starts[lo : lo + 4096]
                hi = starts[lo + 4096] if lo + 4096 < len(starts) else len(word)
                part = index[near[s[0] : hi]] * n[s[0] : hi, None]
                total[word[s]] += np.add.reduceat(part, s - s[0], axis=0)
    blocks = [(i, total[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(BUCKETS // BLOCK)]
    yield pa.RecordBatch.from_pydict({"block": [b for b, _ in blocks], "sums": [s for _, s in blocks]})


def _added(pdf):
    sums = np.sum(sorted((np.frombuffer(s, np.float64) for s in pdf["sums"]), key=lambda a: a.tobytes()), axis=0)
    return pdf.head(1).assign(sums=[sums.tobytes()])


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Unit context vectors by hashed place, from the texts of ``sample``; the common direction is taken out."""
    parts = sample.select("text").mapInArrow(_contexts, "block long, sums binary")
    rows = parts.groupBy("block").applyInPandas(_added, "block long, sums binary").collect()
    table = np.zeros((BUCKETS, DIM))
    for r in rows:
        table[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.float64).reshape(-1, DIM)
    used = np.linalg.norm(table, axis=1) > 0
    if used.any():
        table[used] /= np.linalg.norm(table[used], axis=1, keepdims=True)
        table[used] -= table[used].mean(axis=0)
    return table.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Features of a text; without words all are 0."""
    out = np.zeros(DIM + SHAPE_DIM + 2, np.float32)
    counts = Counter(WORDS.findall(text or ""))
    if not counts:
        return out
    n = np.fromiter(counts.values(), np.float32, len(counts))
    at = np.array([_places(w) for w in counts], np.int64)
    total = n.sum()
    word = np.zeros(DIM)
    for lo in range(0, len(n), 65_536):
        word += n[lo : lo + 65_536] @ vectors[at[lo : lo + 65_536, 0]]
    kinds, where = np.unique(at[:, 1], return_inverse=True)
    out[:DIM] = word / total * 4
    out[DIM : DIM + SHAPE_DIM] = np.bincount(where, n, len(kinds)).astype(np.float32) @ shapes[kinds] / total
    out[-2:] = np.log1p(total) / 4, len(n) / total * 2
    return out


class Network:
    """Two layers; probabilities are the logistic function of logit / temperature."""

    def __init__(self, inputs: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w = [rng.normal(0, (2 / inputs) ** 0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w[3][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        rng, x = np.random.default_rng(SEED), (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                b = order[lo : lo + BATCH]
                h = np.maximum(x[b] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3][0]
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
                dh = np.outer(d, self.w[2]) * (h > 0)
                grads, t = [x[b].T @ dh + 1e-4 * self.w[0], dh.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True)], t + 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on rows not fitted."""
        if not len(y):
            return
        z = self.logits(x)
        grid = np.exp(np.linspace(0, np.log(16), 121))  # scores are only ever softened
        loss = [np.mean(np.logaddexp(0, -np.where(y > 0, z, -z) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def held_out() -> Column:
    """Documents whose labels are never learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most SAMPLE labelled documents, picked by a hash of the id.

    Labels that are NULL, contradict each other or are held out are not used; of rows with one id the smallest text
    counts. Without usable labels, or with one class only, the score is the classes' smoothed share.
    """
    usable = (
        labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("_y"))
        .where("y = _y")
    )
    picked = usable.select("doc_id", "y").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE)
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .repartition(SAMPLE_CHUNKS, "doc_id")
    )
    vectors, shapes = word_vectors(sample), index_vectors(SHAPE_DIM, SEED + 1)

    def featured(batches):
        for b in batches:
            x = [pooled(t.as_py(), vectors, shapes).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted(sample.select("doc_id", "y", "text").mapInArrow(featured, "doc_id long, y int, x binary").collect())
    net = Network(DIM + SHAPE_DIM + 2)
    y = np.array([r.y for r in rows], np.float64)
    if len(set(y)) < 2:
        net.w = [w * 0 for w in net.w]
        net.w[3][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return vectors, net
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    kept = np.array([crc32(b"%d" % r.doc_id) % 5 == 0 for r in rows])  # for calibration
    if len(set(y[~kept])) < 2:
        kept[:] = False
    net.fit(x[~kept], y[~kept])
    net.calibrate(x[kept], y[kept])
    return vectors, net


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= 0.5), one row per row.

    Scores depend on the text alone. NULL and empty texts get the network's score for no words. An empty table gives
    an empty result. Columns named score, predicted or held_out are replaced; others stay.
    """
    vectors, net = fit(docs, labels)
    shapes = index_vectors(SHAPE_DIM, SEED + 1)
    cols = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at = cols.index("text")

    def score(batches):
        for b in batches:
            x = np.stack([pooled(t.as_py(), vectors, shapes) for t in b.column(at)]) if b.num_rows else np.zeros((0, DIM + SHAPE_DIM + 2))
            p = net.probabilities(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"c{i} {fields[c]}" for i, c in enumerate(cols)), "score double"])
    out = plain.mapInArrow(score, schema)
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return scored(docs.select("doc_id", "text"), labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")
