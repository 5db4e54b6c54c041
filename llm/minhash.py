"""Near-duplicate documents by MinHash with tensored banding.

Two collections of M half keys of HALF minhashes each are computed per document. A table key joins one half key of
each collection, so 2 * M * HALF minhashes make M * M tables of 2 * HALF rows. Half keys that no second document has
cannot be part of a shared table key and are dropped before keys are formed. Candidates are confirmed on full sets of
shingles; only links between different sets matter, since documents with equal sets form one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from llm.common import WORDS, components, remember, stash

SHINGLE = 5
PERCENT = 75
M, HALF = 16, 4
#: Pairs whose signatures agree less are not compared; at 75 % similarity this is almost four standard deviations off.
LEAST_AGREEMENT = 0.6
BLOCK = 512  # members of a bucket that are compared with each other, or with as many others, in one task
SLICE = 64  # pairs confirmed against one document in one go
_MEMO = 1 << 18

_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_rng = np.random.default_rng(9)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 32, 2 * M * HALF, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, 2 * M * HALF, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_words: dict[str, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word(w: str) -> int:
    if len(_words) >= _MEMO:
        _words.clear()
    h = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    if len(w) <= 64:
        _words[w] = h
    return h


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; a shorter text is one shingle, none without words."""
    get = _words.get
    found = WORDS.findall((text or "").translate(_LOWER))
    ids = np.array([get(w) or _word(w) for w in found], np.uint64)
    n = len(ids) - SHINGLE + 1
    if not len(ids):
        return ids
    if n < 1:
        ids = np.r_[ids, np.full(1 - n, len(ids), np.uint64)]  # a short text differs from any longer one
        n = 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = _mixed(h + ids[k : k + n] * _STEP[k])
    return np.unique(h)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    out = np.full(2 * M * HALF, np.uint32(2**32 - 1))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(short), 256):
        part = short[lo : lo + 256, None] ^ _FLIP
        part *= _ODD
        out = np.minimum(out, part.min(axis=0))
    return out


def half_keys(mins: np.ndarray) -> np.ndarray:
    """M half keys of each collection; the lowest bit tells the collection."""
    at = np.arange(2 * M, dtype=np.uint64)
    h, groups = at, mins.astype(np.uint64).reshape(2 * M, HALF)
    for k in range(HALF):
        h = _mixed(h + groups[:, k])
    return (h & ~np.uint64(1)) | (at >= M)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember("minhash", _words)
    for b in batches:
        out = {"n": [], "cid": [], "halves": [], "signature": []}
        for t in b.column(2):
            s = shingles(t.as_py())
            out["n"].append(len(s))
            if not len(s):
                out["cid"].append(None), out["halves"].append(None), out["signature"].append(None)
                continue
            mins = minhashes(s)
            out["cid"].append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True))
            out["halves"].append(half_keys(mins).view(np.int64))
            out["signature"].append((mins >> np.uint32(24)).astype(np.uint8).tobytes())
        types = {"n": pa.int64(), "cid": pa.int64(), "halves": pa.list_(pa.int64()), "signature": pa.binary()}
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(out[c], t) for c, t in types.items())], names=["doc_id", "th", *types]
        )


def described(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, n, cid, halves, signature) of (doc_id, text): th tells texts apart, cid sets of shingles."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(_described, f"doc_id {kind}, th long, n long, cid long, halves array<bigint>, signature binary")


def buckets(classes: DataFrame) -> DataFrame:
    """Rows (key, left, cid, hub) of all table keys that several classes have.

    ``left`` is the key's half of the first collection. ``hub`` is the member of the bucket with the most shared keys
    altogether: the text that most others are near to, and so the one most likely to be linked with them.
    """
    halves = classes.select("cid", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    per_class = halves.join(shared, "half").groupBy("cid").agg(F.collect_list("half").alias("halves"))
    keys = (
        per_class.withColumn("left", F.explode(F.filter("halves", lambda h: h.bitwiseAND(F.lit(1)) == 0)))
        .withColumn("right", F.explode(F.filter("halves", lambda h: h.bitwiseAND(F.lit(1)) == 1)))
        .select("cid", "left", F.xxhash64("left", "right").alias("key"))
    )
    keys = stash(keys, "keys")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = stash(keys.join(several, "key"), "keys")
    degrees = keys.groupBy("cid").agg(F.count("*").alias("degree"))
    hubs = keys.join(degrees, "cid").groupBy("key").agg(F.max(F.struct("degree", "cid")).alias("hub"))
    return stash(keys.join(hubs.select("key", F.col("hub.cid").alias("hub")), "key"), "buckets")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
            good = pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["a", "b"])


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    marks = classes.select("cid", "signature")
    both = pairs.join(marks.toDF("a", "x"), "a").join(marks.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_agreeing, "a long, b long")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember("minhash", _words)
    at, own = None, None
    for batch in batches:
        found = []
        for a, part, member, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not member:
                at, own = (a, part), shingles(text)
            elif at == (a, part):
                other = shingles(text)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= PERCENT * (len(own) + len(other) - common):
                    found.append((a, b))
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())}
        )


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets. The text of ``a`` comes once per slice of its partners."""
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).alias("slices")), "a")
    sliced = sized.select("a", F.pmod(F.xxhash64("b"), "slices").alias("part"), "b")
    members = sliced.join(texts.withColumnRenamed("cid", "b"), "b").select("a", "part", F.lit(1).alias("member"), "b", "text")
    owners = sliced.select("a", "part").distinct().join(texts.withColumnRenamed("cid", "a"), "a")
    rows = owners.select("a", "part", F.lit(0).alias("member"), F.col("a").alias("b"), "text").union(members)
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(_confirmed, "a long, b long")


class _Block:
    """Members of one part of a bucket, compared pair by pair without writing pairs out."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows  # (block, cid, component, halves, signature, text)
        self.sets: dict[int, np.ndarray] = {}

    def set_of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = shingles(self.rows[i][5])
        return self.sets[i]

    def links(self, left: int, x: int, y: int) -> list[tuple[int, int]]:
        """Links between blocks x and y that join components; at most one per member."""
        first = [i for i, r in enumerate(self.rows) if r[0] == x]
        second = first if x == y else [i for i, r in enumerate(self.rows) if r[0] == y]
        halves = np.array([r[3] for r in self.rows], np.int64).reshape(len(self.rows), 2 * M)
        marks = np.frombuffer(b"".join(r[4] for r in self.rows), np.uint8).reshape(len(self.rows), -1)
        own = np.argmax(halves[:, :M] == left, axis=1)  # which table of the first collection this bucket is in
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        found, rest = [], np.array(second)
        for i in first:
            js = rest[rest > i] if x == y else rest
            js = js[(marks[js] == marks[i]).mean(axis=1) >= LEAST_AGREEMENT]
            same = halves[js] == halves[i]
            js = js[same[:, M:].any(axis=1) & (np.argmax(same[:, :M], axis=1) == own[i])]  # in the first shared table only
            for j in js.tolist():
                a, b = root(self.rows[i][2]), root(self.rows[j][2])
                if a == b:
                    continue
                s, t = self.set_of(i), self.set_of(j)
                if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
                    continue
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= PERCENT * (len(s) + len(t) - common):
                    top[max(a, b)] = min(a, b)
                    found.append((self.rows[i][1], self.rows[j][1]))
        return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(at, rows):
        found = _Block(rows).links(*at) if at and len(rows) > 1 else []
        return pa.RecordBatch.from_pydict(
            {"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())}
        )

    remember("minhash", _words)
    at, rows = None, []
    for batch in batches:
        for left, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (left, x, y) != at:
                yield done(at, rows)
                at, rows = (left, x, y), []
            rows.append(tuple(row))
    yield done(at, rows)


def across(shared: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that still share a table key.

    Members of a bucket lie in blocks, and each pair of blocks is one group of rows, so a bucket of any size is
    spread over tasks. A pair that shares several table keys is compared in its first shared bucket only.
    """
    placed = shared.join(labels.withColumnRenamed("node", "cid"), "cid").select("key", "left", "cid", "component")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    members = placed.join(mixed, "key").select("left", "cid", "component").distinct()
    blocks = members.groupBy("left").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")),
    )
    dealt = members.join(blocks, "left").withColumn("block", own).withColumn("pair", F.explode(pairs))
    full = dealt.join(classes.select("cid", "halves", "signature"), "cid").join(texts, "cid")
    rows = full.select("left", "pair.x", "pair.y", "block", "cid", "component", "halves", "signature", "text")
    return rows.repartition("left", "x", "y").sortWithinPartitions("left", "x", "y", "cid").mapInArrow(_compared, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, n_shingles, cid, root, component_id), one per row of ``docs`` (doc_id, text).

    Rows with equal sets of shingles share ``cid``; rows that links connect share ``root``. component_id is the
    smallest doc_id of the root. Rows without words (NULL, empty, white space only) have no cid and stand alone with
    their own doc_id. NULL doc_ids take part but are no group's smallest id unless all are NULL. Repeated rows count
    as equal documents. An empty table gives an empty result.

    Links are looked for in two rounds: members of a bucket against its most central class, then, where a bucket
    still holds several components, all its pairs across components. Pairs within a component need no link of their
    own.
    """
    rows = stash(described(docs), "described")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = stash(
        rows.where("cid is not null").groupBy("cid").agg(F.min(named).alias("first"), F.first("halves").alias("halves"), F.first("signature").alias("signature")),
        "classes",
    )
    shared = buckets(classes)
    wanted = classes.join(shared.select("cid").distinct(), "cid").select("cid", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"))
    full = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))
    texts = stash(
        full.join(wanted.alias("w"), same).groupBy("cid").agg(F.first("text").alias("text")), "texts"
    )
    stars = shared.where("hub <> cid").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    links = stash(confirmed(likely(stars, classes), texts), "links")
    labels = components(links.union(classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"))))
    more = stash(across(shared, labels, classes, texts), "links")
    joined = more.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    again = components(joined)
    final = (
        labels.join(again.toDF("component", "merged"), "component", "left")
        .select(F.col("node").alias("cid"), F.coalesce("merged", "component").alias("root"))
    )
    least = classes.join(final, "cid").groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    known = final.join(least, "root")
    return rows.join(known, "cid", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), "cid", "root",
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``, with all its columns: a row with the group's smallest doc_id.

    Rows without words are in no group and all stay.
    """
    found = stash(near_duplicates(docs.select("doc_id", "text")), "groups")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    stay = found.where("root is not null").groupBy("root").agg(F.min(named).alias("first")).select("root", "first.doc_id", "first.th")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.struct(*cols).alias("row"))
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th"))
    kept = rows.alias("d").join(stay.alias("s"), same).groupBy("s.root").agg(F.first("row").alias("row")).select("row.*")
    wordless = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.union(wordless.select(*cols))
