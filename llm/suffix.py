"""Removal of repeated byte strings by hash names around content-defined anchors, in place of prefix doubling.

Every string of LENGTH bytes contains an anchor: the one of its GRAM-byte strings with the least hash, so equal
strings have equal anchors at equal offsets, and it is enough to rank suffixes at anchors. Ranks are names: equal
strings get equal names. Names are formed at growing lengths around the anchor, and whatever is unique, or known to
repeat over the whole length, leaves after each round:

1. the anchor's GRAM bytes; positions whose name is unique leave, since no string through them can repeat;
2. all strings of an anchor at once, one name for the bytes they cover; a repeated name settles all of them;
3. for anchors that are left, STEP strings at once: a repeated name settles them, and a group whose common core has
   no two different names has nothing more to tell apart;
4. single strings of LENGTH bytes.

One member of each settled name stays as a witness for strings that only share a part with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import remember, stash

LENGTH = 200
GRAM = 64
STEP = 16
SEGMENT = 1 << 20  # strings that are hashed at a time
_REACH = LENGTH - GRAM + 1

_rng = np.random.default_rng(2)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(SEGMENT + LENGTH + 1, np.uint64(base))
            row[0] = 1
            _powers.append(np.cumprod(row))
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def each(self, length: int) -> np.ndarray:
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per segment: (at, low, high, gram, name), the anchors and the first and last string of each."""
    for s in range(0, len(data) - LENGTH + 1, SEGMENT):
        h = Hashes(data[s : s + SEGMENT + LENGTH - 1])
        grams = h.each(GRAM)
        least = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= _REACH:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (_REACH - span)], least[_REACH - span :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        high = np.r_[low[1:], len(at)] - 1
        at = at[low]
        place = _mixed((at - low).astype(np.uint64) * np.uint64(LENGTH) + (high - low).astype(np.uint64))
        yield at + s, low + s, high + s, grams[at], h.of(low, high + LENGTH) ^ place


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember("suffix", _powers)
    seen: set[int] = set()  # equal texts of one task are read once; that they repeat is known from their number
    names = ["rid", "at", "low", "high", "gram", "name"]
    for b in batches:
        for rid, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if rid in seen:
                continue
            seen.add(rid)
            for at, low, high, gram, name in anchors(np.frombuffer(data.as_buffer(), np.uint8)):
                ids = pa.array(np.full(len(at), rid, np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(low), pa.array(high), _i64(gram), _i64(name)], names=names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        out = []
        for rid, data, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            if rid != last:
                view = memoryview(data.as_buffer())
                out += [(rid, w["at"], w["low"], w["high"], w["gram"], w["weight"], bytes(view[w["low"] : w["high"] + LENGTH])) for w in wanted]
            last = rid
        kinds = [*[pa.int64()] * 5, pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["rid", "at", "low", "high", "gram", "weight", "bytes"]
        )


def _pooled(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Hashes, np.ndarray]]:
    """Rows lo to hi - 1 of a batch with their bytes end to end in one hash table, and where each row begins."""
    sizes = np.array([len(x) for x in batch.column(column).to_pylist()], np.int64)
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), SEGMENT, side="right")))
        data = np.frombuffer(b"".join(batch.column(column)[lo:hi].to_pylist()), np.uint8)
        yield lo, hi, Hashes(data), np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        lo = hi


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, at, gram, weight, step, first, last, whole, core): STEP offsets before the anchor at a time."""
    remember("suffix", _powers)
    names = ["rid", "at", "gram", "weight", "step", "first", "last", "whole", "core"]
    for b in batches:
        for lo, hi, h, base in _pooled(b, b.num_columns - 1):
            rid, at, low, high, gram, weight = (_numbers(b, c)[lo:hi] for c in ("rid", "at", "low", "high", "gram", "weight"))
            least = (at - high) // STEP
            n = (at - low) // STEP + 1 - least
            row = np.repeat(np.arange(hi - lo), n)
            step = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            top = at[row] - step * STEP
            first, last = np.maximum(low[row], top - STEP + 1), np.minimum(high[row], top)
            shift = base[row] - low[row]
            whole = h.of(first + shift, last + shift + LENGTH) ^ _mixed(((at[row] - first) * LENGTH + at[row] - last).astype(np.uint64))
            # the bytes that all STEP strings share
            core = h.of(top + shift, top + shift - STEP + 1 + LENGTH)
            cols = [pa.array(x) for x in (rid[row], at[row], gram[row], weight[row], step, first, last)]
            yield pa.RecordBatch.from_arrays([*cols, _i64(whole), _i64(core)], names=names)


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, start, offset, gram, weight, name) of single strings."""
    remember("suffix", _powers)
    names = ["rid", "start", "offset", "gram", "weight", "name"]
    for b in batches:
        steps = b.column(b.num_columns - 1).to_pylist()
        for lo, hi, h, base in _pooled(b, b.num_columns - 2):
            rid, at, low, gram = (_numbers(b, c)[lo:hi] for c in ("rid", "at", "low", "gram"))
            flat = [(k, r["first"], r["last"], r["weight"]) for k, rows in enumerate(steps[lo:hi]) for r in rows]
            row, first, last, weight = (np.array(x, np.int64) for x in zip(*flat, strict=True))
            n = last + 1 - first
            start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, weight = np.repeat(row, n), np.repeat(weight, n).astype(np.int32)
            here = start - low[row] + base[row]
            cols = [pa.array(x) for x in (rid[row], start, at[row] - start, gram[row], weight)]
            yield pa.RecordBatch.from_arrays([*cols, _i64(h.of(here, here + LENGTH))], names=names)


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """Rows (rid, low, high) of (rid, data): strings starting at low to high occur more than once.

    Texts with equal rid are equal; where several rows have one, the caller knows that all of it repeats.
    """
    kinds = "rid long, at long, low long, high long, gram long, name long"
    found = texts.mapInArrow(_anchored, kinds)
    grams = stash(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    left = stash(found.join(grams, "gram"), "anchors")
    names = stash(
        left.groupBy("gram", "name").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at", "low", "high")).alias("one")), "names"
    )
    settled = left.join(names.where("n > 1").select("gram", "name"), ["gram", "name"]).select("rid", "low", "high")

    wanted = names.join(names.where("n = 1").select("gram").distinct(), "gram").select("one.*", "gram", F.least("n", F.lit(2)).cast("int").alias("weight"))
    per_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "low", "high", "gram", "weight")).alias("wanted"))
    cut = stash(
        texts.join(per_text, "rid").select("rid", "data", "wanted").mapInArrow(_cut_out, "rid long, at long, low long, high long, gram long, weight int, bytes binary"),
        "cut",
    )
    parts = stash(cut.mapInArrow(_intervals, "rid long, at long, gram long, weight int, step long, first long, last long, whole long, core long"), "steps")
    wholes = stash(
        parts.groupBy("gram", "whole", "core", "step").agg(
            F.sum("weight").alias("n"), F.min(F.struct("rid", "at", "first", "last")).alias("one")
        ),
        "wholes",
    )
    at = ["gram", "whole", "core", "step"]
    steps = parts.where("weight = 1").join(wholes.where("n > 1").select(*at), at).select("rid", F.col("first").alias("low"), F.col("last").alias("high"))

    mixed = wholes.groupBy("gram", "core", "step").agg(F.count("*").alias("names"), F.min("n").alias("least")).where("names > 1 and least = 1")
    open_ones = wholes.join(mixed.select("gram", "core", "step"), ["gram", "core", "step"]).select("one.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    # an anchor of strings on both sides of a segment's end comes once from each segment
    part = ["rid", "at", "segment"]
    per_anchor = open_ones.withColumn("segment", F.expr(f"first div {SEGMENT}")).groupBy(*part).agg(F.collect_list(F.struct("first", "last", "weight")).alias("rows"))
    single = stash(
        cut.withColumn("segment", F.expr(f"low div {SEGMENT}")).dropDuplicates(part).join(per_anchor, part).select("rid", "at", "low", "gram", "bytes", "rows")
        .mapInArrow(_singles, "rid long, start long, offset long, gram long, weight int, name long"),
        "singles",
    )
    key = ["gram", "offset", "name"]
    again = single.groupBy(*key).agg(F.sum("weight").alias("n")).where("n > 1").select(*key)
    last = single.where("weight = 1").join(again, key).select("rid", F.col("start").alias("low"), F.col("start").alias("high"))
    return settled.union(steps).union(last)


def removed_runs(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes covered by strings that start at low to high."""
    runs: list[list[int]] = []
    for k in np.argsort(low, kind="stable"):
        start, end = int(low[k]), int(high[k]) + LENGTH
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def without_repeats(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a struct ``_cut``: n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes as text).

    Texts are UTF-8 bytes; NULL counts as empty. Bytes left of a character that was cut in part stay in the checksum
    and are left out of ``kept``. Equal texts repeat as a whole, so those of LENGTH bytes and more are removed
    entirely. Shorter texts stay as they are. An empty table gives an empty result; other columns stay, except those
    in ``drop``. Rows with equal texts are recognized by a 64-bit hash.
    """
    cols = df.columns
    data = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    long_ones = df.select(data.alias("data")).where(F.length("data") >= LENGTH).select(F.xxhash64("data").alias("rid"), "data")
    ranges = repeated_ranges(long_ones)
    found = ranges.distinct().groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    copies = long_ones.groupBy("rid").agg(F.count("*").alias("copies")).where("copies > 1")
    known = stash(
        found.join(copies, "rid", "full").select("rid", F.when(F.col("copies") > 1, F.array().cast("array<struct<low:bigint,high:bigint>>")).otherwise(F.col("ranges")).alias("ranges"), (F.coalesce("copies", F.lit(0)) > 1).alias("all")),
        "ranges",
    )

    kept_cols = [c for c in cols if c not in drop]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, ranges, everything in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = value.as_py()
                if everything:
                    runs = [(0, len(raw))]
                else:
                    rows = ranges or []
                    runs = removed_runs(np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64))
                rest, at = [], 0
                for start, end in runs:
                    rest.append(raw[at:start])
                    at = end
                rest = b"".join([*rest, raw[at:]])
                out.append((len(raw), len(raw) - len(rest), len(runs), sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            new = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)][: 5 if text in kept_cols else 4]
            yield pa.RecordBatch.from_arrays([*b.columns[3:], *new], names=[*b.schema.names[3:], *fields[: len(new)]])

    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    extra = {c: f"c{i}" for i, c in enumerate(kept_cols) if c != text}
    rows = df.select(data.alias("data"), *[F.col(f"`{c}`").alias(n) for c, n in extra.items()]).withColumn(
        "rid", F.when(F.length("data") >= LENGTH, F.xxhash64("data"))
    )
    schema = [*(f"{n} {types[c]}" for c, n in extra.items()), "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
    schema += ["kept string"] if text in kept_cols else []
    out = rows.join(known, "rid", "left").select("data", "ranges", "all", *extra.values()).mapInArrow(removed, ", ".join(schema))
    figures = F.struct(*[F.col(f) for f in fields if f != "kept" or text in kept_cols]).alias("_cut")
    return out.select(*[F.col(n).alias(c) for c, n in extra.items()], figures)
