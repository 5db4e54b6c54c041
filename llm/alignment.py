"""Alignment of two tokenizations of the same bytes, by as-of merges.

Tokens of both sides cover the bytes of space + text without gaps, so each side is a sorted list of starts. In a batch
of documents, ``merge_asof`` keyed by document gives every token start of one side the covering token of the other;
the union of both directions is all overlapping pairs, and ends that both sides share cut the tokens into groups.

Link counts of id pairs over the whole corpus come from one row per pair and batch group, not per link: a group's
documents keep numbers into its list of pairs, the pairs meet their corpus-wide counts in a join, and a second pass
over the groups adds the counts up per document.

Both tokenizers cut before a single space between two characters that are no white space, whatever surrounds them, so
pieces between such cuts are encoded apart and frequent ones are remembered; ids equal those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm.common import stash

BATCH = 1 << 21  # characters of text that are merged at once
PAIRS, BATCHES = 1 << 20, 16  # pairs and batches after which a batch group ends
BROADCAST_PAIRS = 4_000_000  # rows of three numbers; more pairs are joined by a shuffle
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MEMO = 1 << 19  # pieces that are remembered
_LINE = 64  # pieces encoded in one call
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Side:
    """Ids of pieces and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec["pre_tokenizer"] or {}
            if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
                raise ValueError(f"{path}: not a plain byte-level tokenizer")
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
            letters = {c: b for b, c in _byte_letters().items()}
            self.bytes = [b""] * tokenizer.get_vocab_size()
            for entry, k in tokenizer.get_vocab().items():
                known = all(c in letters for c in entry)
                self.bytes[k] = bytes(letters[c] for c in entry) if known else entry.encode()
            self.cuts = True
        else:
            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
            self.bytes = [
                bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
            ]
            plain = model.encode("a  b ﬁ ", out_type=str)
            if "".join(plain) != "▁a▁▁b▁ﬁ▁":
                raise ValueError(f"{path}: the model changes texts or adds no space")
            self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.length = np.array([len(b) for b in self.bytes], np.int64)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Aligner:
    """Aligns batches of texts; one per process and pair of files."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Side(a), Side(b)
        self.cuts = self.a.cuts and self.b.cuts
        most = max(len(self.a.bytes), len(self.b.bytes))
        self.texts = {end: np.array([f"{k}{end}" for k in range(most)], object) for end in ",|;"}
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}  # pieces by number
        self.good = np.zeros(0, bool)  # both sides give the piece's bytes back
        self.sizes = [np.zeros(0, np.int64)] * 2  # per side the tokens of each piece, and all of them in order
        self.flat = [np.zeros(0, np.int32)] * 2

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: LINE at a time where neighbours cannot change them, else each by itself."""
        alone = [not self.cuts or p[:1].isspace() or p[-1:].isspace() or "▁" in p for p in pieces]
        near = [p for p, apart in zip(pieces, alone, strict=True) if not apart]
        lines = [" ".join(near[k : k + _LINE]) for k in range(0, len(near), _LINE)]
        odd = [p for p, apart in zip(pieces, alone, strict=True) if apart]
        sizes, flat = [], []
        want = f" {' '.join(near)}".encode() if near else b""
        edges = np.cumsum([len(p.encode()) + 1 for p in near]) if near else np.zeros(0, np.int64)
        good = np.ones(len(pieces), bool)
        apart = np.array(alone, bool)
        for side in (self.a, self.b):
            ids = np.array([i for line in side.encode(lines) for i in line], np.int32)
            if b"".join([side.bytes[i] for i in ids.tolist()]) == want:
                ends = np.searchsorted(np.cumsum(side.length[ids]), edges, side="right")
                single = [ids[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if odd else None
                size = np.diff(ends, prepend=0)
            else:
                single = [np.array(x, np.int32) for x in side.encode(near)]
                size, ids = np.array([len(x) for x in single], np.int64), np.concatenate(single)
                good[~apart] &= [b"".join([side.bytes[i] for i in x.tolist()]) == f" {p}".encode() for x, p in zip(single, near, strict=True)]
            if odd:
                own = [np.array(x, np.int32) for x in side.encode(odd)]
                good[apart] &= [b"".join([side.bytes[i] for i in x.tolist()]) == f" {p}".encode() for x, p in zip(own, odd, strict=True)]
                near_at, odd_at = iter(single), iter(own)
                every = [next(odd_at) if x else next(near_at) for x in alone]
                size, ids = np.array([len(x) for x in every], np.int64), np.concatenate(every)
            sizes.append(size), flat.append(ids)
        self.good = np.r_[self.good, good]
        self.sizes = [np.r_[old, new] for old, new in zip(self.sizes, sizes, strict=True)]
        self.flat = [np.r_[old, new] for old, new in zip(self.flat, flat, strict=True)]

    def tokens(self, texts: list[str | None]) -> tuple[tuple, ...]:
        """Per side (document, id, start, end) of every token in the batch; documents that do not match have none."""
        if len(self.memo) > _MEMO or sum(map(len, self.flat)) > 16 * _MEMO:
            self.forget()
        old, taken, owner = len(self.memo), [], []
        number = self.memo.setdefault
        for d, text in enumerate(texts):
            if text:
                parts = _CUT.split(text) if self.cuts else [text]
                taken += [number(p, len(self.memo)) for p in parts]
                owner.append((d, len(parts)))
        if len(self.memo) > old:
            self._learn(list(islice(self.memo, old, None)))
        taken = np.array(taken, np.int64)
        owner = np.repeat([d for d, _ in owner], [n for _, n in owner]).astype(np.int64)
        wrong = ~self.good[taken]
        if wrong.any():
            kept = ~np.isin(owner, owner[wrong])
            taken, owner = taken[kept], owner[kept]
        sides = []
        for sizes, flat, length in zip(self.sizes, self.flat, (self.a.length, self.b.length), strict=True):
            first, each = np.cumsum(sizes) - sizes, sizes[taken]
            token = flat[np.arange(each.sum()) + np.repeat(first[taken] - (np.cumsum(each) - each), each)]
            end = np.cumsum(length[token])
            sides.append((np.repeat(owner, each), token, end - length[token], end))
        return tuple(sides)

    def links(self, sides: tuple) -> tuple[np.ndarray, np.ndarray]:
        """All overlapping pairs, as places among the tokens of A and of B."""
        a, b = (pd.DataFrame({"start": s[2], "doc": s[0], "place": np.arange(len(s[1]))}) for s in sides)
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of_a = pd.merge_asof(a, b.rename(columns={"place": "other"}), on="start", by="doc")
        of_b = pd.merge_asof(b, a.rename(columns={"place": "other"}), on="start", by="doc")
        covering = of_b["other"].to_numpy()
        new = sides[0][2][covering] != sides[1][2]  # pairs with equal starts are found from both sides
        return np.r_[of_a["place"], covering[new]], np.r_[of_a["other"], of_b["place"].to_numpy()[new]]

    def groups(self, sides: tuple, count: int) -> tuple[np.ndarray, list[str]]:
        """Groups per document and the digest of their ids."""
        (doc_a, id_a, _, end_a), (doc_b, id_b, _, end_b) = sides
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = end_a == shared[group_a] if len(shared) else end_a == 0, end_b == shared[group_b] if len(shared) else end_b == 0
        text = np.empty(len(id_a) + len(id_b), object)
        before_b = np.searchsorted(group_b, group_a)  # tokens of B in earlier groups
        before_a = np.searchsorted(group_a, group_b, side="right")  # tokens of A up to this group
        text[np.arange(len(id_a)) + before_b] = np.where(last_a, self.texts["|"][id_a], self.texts[","][id_a])
        text[np.arange(len(id_b)) + before_a] = np.where(last_b, self.texts[";"][id_b], self.texts[","][id_b])
        upto = np.searchsorted(doc_a, np.arange(count + 1)) + np.searchsorted(doc_b, np.arange(count + 1))
        digests = ["" if lo == hi else sha256("".join(text[lo:hi])[:-1].encode()).hexdigest() for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return np.bincount(doc_a[last_a], minlength=count), digests


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


_FIELDS = {
    "grp": pa.int64(), "row": pa.int64(), "pair": pa.int64(), "n": pa.int64(), "local": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(),
    "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary(),
}
_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
_SCHEMA = ", ".join(f"{c} {_NAMES[t]}" for c, t in _FIELDS.items())


def _aligned(batches: Iterator[pa.RecordBatch], a: str, b: str, extra: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Document rows (grp, row, counts, numbers of pairs, other columns) and pair rows (grp, pair, n, local)."""
    machine, base, group, held, at = aligner(a, b), TaskContext.get().partitionId() << 32, 0, 0, 0
    known, local, totals = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fields = _FIELDS | {f.name: f.type for f in extra}

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        out = [pa.nulls(size, t) if (x := columns.get(c)) is None else x if isinstance(x, pa.Array) else pa.array(x, t) for c, t in fields.items()]
        return pa.RecordBatch.from_arrays(out, names=list(fields))

    def listed() -> pa.RecordBatch:
        return rows(grp=np.full(len(known), base + group), pair=known, n=totals[local], local=local.astype(np.int32))

    for texts, others in _batched(batches):
        count, sides = len(texts), machine.tokens(texts)
        of_a, of_b = machine.links(sides)
        n_groups, digests = machine.groups(sides, count)
        doc = sides[0][0][of_a]
        pair = sides[0][1][of_a].astype(np.int64) << 24 | sides[1][1][of_b]
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(doc)])
        doc, pair = doc[first], pair[first]
        new = np.setdiff1d(pair, known)
        local = np.r_[local, len(known) + np.arange(len(new))]
        known = np.r_[known, new]
        by = np.argsort(known, kind="stable")
        known, local = known[by], local[by]
        number = local[np.searchsorted(known, pair)]
        totals = np.r_[totals, np.zeros(len(new), np.int64)]
        totals += np.bincount(number, times, len(totals)).astype(np.int64)
        ends = np.searchsorted(doc, np.arange(count + 1)).tolist()
        packed = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            by = np.argsort(number[lo:hi])
            packed.append((np.diff(number[lo:hi][by], prepend=0).astype("<u4").tobytes(), times[lo:hi][by].astype("<u4").tobytes()))
        yield rows(
            grp=np.full(count, base + group), row=base + at + np.arange(count), n_a=np.bincount(sides[0][0], minlength=count), n_b=np.bincount(sides[1][0], minlength=count),
            n_groups=n_groups, n_links=np.bincount(doc, times, count).astype(np.int64), groups_sha256=digests,
            pairs=[p for p, _ in packed], times=[t for _, t in packed], **dict(zip(extra.names, others, strict=True)),
        )
        at, held = at + count, held + 1
        if len(known) > PAIRS or held == BATCHES:
            yield listed()
            group, held = group + 1, 0
            known, local, totals = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield listed()


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[pa.Array]]]:
    """Texts and other columns of about BATCH characters at a time."""
    texts, parts, size = [], [], 0

    def whole():
        return texts, [pa.concat_arrays(c) for c in zip(*parts, strict=True)]

    for b in batches:
        lo = 0
        for k, text in enumerate(b.column(0)):
            text = text.as_py()
            texts.append(text)
            size += len(text or "") + 64
            if size >= BATCH:
                parts.append(b.slice(lo, k + 1 - lo).columns[1:])
                yield whole()
                texts, parts, size, lo = [], [], 0, k + 1
        if lo < b.num_rows:
            parts.append(b.slice(lo).columns[1:])
    if texts:
        yield whole()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the links of highest count and the sum of counts; a group's pairs come before its documents."""
    at, parts, total, best = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        grp, is_doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (is_doc[1:] != is_doc[:-1])]) if len(grp) else []
        out = []
        for lo, hi in zip(cut, [*cut[1:], len(grp)], strict=True):
            part = b.slice(lo, hi - lo)
            if not is_doc[lo]:
                if at != grp[lo]:
                    at, parts = grp[lo], []
                parts.append((part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy()))
                continue
            if at != grp[lo]:
                at, parts, total, best = grp[lo], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            if parts:
                where, n, top = (np.concatenate(c) for c in zip(*parts, strict=True))
                total, best, parts = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64), []
                total[where], best[where] = n, top
            for row, pairs, times in zip(*(part.column(k).to_pylist() for k in (2, 6, 7)), strict=True):
                p, t = np.cumsum(np.frombuffer(pairs, "<u4").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
                out.append((row, int(t @ best[p]), int(t @ total[p])))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["row", "n_best", "count_sum"])


def pair_counts(coded: DataFrame) -> DataFrame:
    """Rows (pair, total, best): links of each id pair in the corpus, and 1 where no pair of the same B id has more."""
    counts = stash(coded.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 24) - 1)).alias("b")
    top = counts.groupBy(b).agg(F.max("total").alias("top"))  # at most one row per id of the vocabulary
    joined = counts.join(F.broadcast(top), F.expr(f"pair & {(1 << 24) - 1}") == top.b)
    return joined.select("pair", "total", (F.col("total") == F.col("top")).cast("long").alias("best"))


def alignments(df: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and groups_sha256.

    ``a`` is a byte-level tokenizer's .json, given space + text; ``b`` a SentencePiece .model that adds the space
    itself; every executor can open both. NULL and empty texts, and texts whose bytes one side does not give back, have no tokens: zeros
    and an empty digest. One row per row; repeated rows count each. Columns of those names are replaced, others stay;
    an empty table gives an empty result. Texts are read whole.
    """
    cols = [c for c in df.columns if c not in (*COLUMNS, text)]
    plain = df.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    extra = to_arrow_schema(plain.drop("text").schema)
    types = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(cols)]
    coded = stash(plain.mapInArrow(lambda batches: _aligned(batches, a, b, extra), ", ".join([_SCHEMA, *types])), "aligned")
    pairs = stash(pair_counts(coded), "pair-counts")
    few = pairs.count() <= BROADCAST_PAIRS
    listed = coded.where("pair is not null").select("grp", "pair", "local").join(F.broadcast(pairs) if few else pairs, "pair")
    empty = [F.lit(None).cast("binary").alias(c) for c in ("pairs", "times")]
    zero = [F.lit(0).cast(t).alias(c) for c, t in (("local", "int"), ("total", "long"), ("best", "long"))]
    both = listed.select("grp", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), "local", "total", "best", *empty).union(
        coded.where("row is not null").select("grp", F.lit(1).alias("kind"), "row", *zero, "pairs", "times")
    )
    sums = both.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(_summed, "row long, n_best long, count_sum long")
    own = coded.where("row is not null").drop("grp", "pair", "n", "local", "pairs", "times")
    return own.join(sums, "row").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], *COLUMNS)
