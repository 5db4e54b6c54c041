"""SentencePiece encoding and decoding over a relational lattice.

Texts split into units that no piece reaches beyond. Distinct units are exploded into substrings of bounded length,
which an equi-join with the piece table turns into the edges of a lattice; edges are grouped by unit, and a fold over
them with Spark's higher-order ``aggregate`` picks the path. The model's pieces are merge ranks (its type is BPE), so
the fold takes the best-scoring edge that joins two neighbouring segments until none is left, which is how such a
model encodes; a sum of scores along the path would give other pieces.

Units that occur often are encoded this way, once each, and reach the texts as a dictionary of bounded size. The many
units that occur a few times are merged by the same rule where they are met, since joining them with the lattice and
back to their texts costs several times the work (figures in the README); units beyond the fold's length are, too.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from llm.common import remember, stash

BAR = "▁"  # stands for a space
FOLDED = 60  # characters of a unit that the fold handles, as bits of a long; longer ones are merged where they are met
DICTIONARY = 1 << 18  # frequent units that are encoded by the lattice and sent to every executor
COUNTED = 1 << 18  # different units that a task counts before it hands them on
_MEMO = 1 << 18
_UNITS = re.compile(f"{BAR}*[^{BAR}\n]+|{BAR}+|\n")


class Model:
    """The piece table of a model file: byte fallback, merges by score, a space before the text, no other change."""

    def __init__(self, path: str):
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        probe = "  a\t ﬁé \r\n "
        if (
            len(self.bytes) != 256
            or list(self.bytes[b] - self.bytes[0] for b in range(256)) != list(range(256))
            or any(re.search(f"[^{BAR}]{BAR}|\n", p) for p in self.ids)
            or sp.decode(sp.encode(probe)) != probe
        ):
            raise ValueError(f"{path}: only models with byte fallback and without normalization can be used")
        self.pairs = frozenset(p[k : k + 2] for p in self.ids for k in range(len(p) - 1))

    def units(self, text: str) -> list[str]:
        """The text as units: a run of spaces with what follows, line ends, and long ones cut where no piece has both
        neighbours."""
        if not text:
            return []
        found = _UNITS.findall(BAR + text.replace(" ", BAR))
        if max(map(len, found)) <= FOLDED:
            return found
        out = []
        for u in found:
            start = 0
            for k in range(1, len(u)) if len(u) > FOLDED else ():
                if u[k - 1 : k + 1] not in self.pairs:
                    out.append(u[start:k])
                    start = k
            out.append(u[start:])
        return out

    def merged(self, unit: str) -> bytes:
        """Ids of one unit, by merging neighbours: best score first, leftmost among equals."""
        part = self._merged_short(unit) if len(unit) <= FOLDED else self._merged_long(unit)
        ids = list(map(self.coded.get, part))
        if None in ids:
            ids = [b"".join(self.bytes[b].to_bytes(4, "little") for b in p.encode("utf-8")) if x is None else x for x, p in zip(ids, part, strict=True)]
        return b"".join(ids)

    def _merged_short(self, unit: str) -> list[str]:
        get, never = self.scores.get, -math.inf
        part = list(unit)
        joins = [get(a + b, never) for a, b in zip(part, part[1:], strict=False)]
        while joins:
            best = max(joins)
            if best == never:
                break
            i = joins.index(best)
            part[i] += part.pop(i + 1)
            del joins[i]
            if i:
                joins[i - 1] = get(part[i - 1] + part[i], never)
            if i < len(joins):
                joins[i] = get(part[i] + part[i + 1], never)
        return part

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a queue."""
        part, scores = list(unit), self.scores
        n = len(part)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        queue = [(-scores[p], i, len(part[i]), p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in scores]
        heapq.heapify(queue)
        while queue:
            _, i, own, p = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or len(part[i]) != own or part[i] + part[j] != p:
                continue
            part[i], gone[j], after[i] = p, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := p + part[after[i]]) in scores:
                    heapq.heappush(queue, (-scores[q], i, len(p), q))
            if (k := before[i]) >= 0 and (q := part[k] + p) in scores:
                heapq.heappush(queue, (-scores[q], k, len(part[k]), q))
        return [part[i] for i in range(n) if not gone[i]]

    def decoder(self) -> dict[int, bytes]:
        table = {i: p.replace(BAR, " ").encode("utf-8") for p, i in self.ids.items()}
        return table | {i: bytes([b]) for b, i in self.bytes.items()}


def decode(ids: list[int], table: dict[int, bytes]) -> str:
    """The text of ids; the space put before a text goes, ids outside the table give nothing."""
    data = b"".join([table.get(i, b"") for i in ids])
    return data[data.startswith(b" ") :].decode("utf-8", "replace")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _field(edge: Column, low: int, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", edge, F.lit(low)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _folded(unit: Column, edges: Column, first_byte: int) -> Column:
    """Ids of a unit from its edges, longs of (merge rank, start, end, id) from high to low bits.

    Bits 0 to n of a long mark where segments begin and end; an edge fits when it spans exactly two segments.
    """
    n = F.length(unit)
    joining = F.filter(edges, lambda e: _field(e, 16, 6) > _field(e, 22, 6) + 1)
    merges = F.transform(
        F.sort_array(joining),
        lambda e: F.struct(
            _bit(_field(e, 22, 6)).bitwiseOR(_bit(_field(e, 16, 6))).alias("ends"),
            (_bit(_field(e, 16, 6)) - _bit(_field(e, 22, 6) + 1)).alias("inner"),
        ),
    )

    def best(mask: Column, steps: Column) -> Column:
        fits = F.filter(steps, lambda e: (mask.bitwiseAND(e.ends) == e.ends) & (F.bit_count(mask.bitwiseAND(e.inner)) == 1))
        return F.coalesce(mask.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inner"])), mask)

    def marks(steps: Column) -> Column:
        rounds = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(2))), F.lit(1), F.least(n - 1, F.size(steps)))
        return F.aggregate(rounds, _bit(n + 1) - 1, lambda mask, _: best(mask, steps))

    def ids(s: Column, e: Column) -> Column:
        span = s.cast("long") * 64 + e
        known = F.get(F.filter(edges, lambda x: F.call_function("shiftrightunsigned", x, F.lit(16)).bitwiseAND(F.lit(4095)) == span), F.lit(0))
        raw = F.hex(F.encode(F.substring(unit, s + 1, e - s), "UTF-8"))
        fallback = F.transform(
            F.sequence(F.lit(1), F.length(raw), F.lit(2)),
            lambda k: F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int") + first_byte,
        )
        return F.when(known.isNotNull(), F.array(_field(known, 0, 16))).otherwise(fallback)

    def path(mask: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), n), lambda i: mask.bitwiseAND(_bit(i)) != 0)
        return F.flatten(F.transform(F.array(at), lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), ids))[0])

    return F.flatten(F.transform(F.transform(F.array(merges), marks), path))


def encoded_units(units: DataFrame, model: Model) -> DataFrame:
    """Rows (unit, n, ids) of rows (unit, n), n added up per unit: lattice, group, fold."""
    spark = units.sparkSession
    order = {c: k for k, c in enumerate(sorted({-s for s in model.scores.values()}))}
    rows = [(p, (order[-model.scores[p]] << 28) | i) for p, i in model.ids.items()] + [("", -1)]
    # joined on a hash, which is a long and much cheaper to look up, and then compared as text
    table = F.broadcast(spark.createDataFrame(rows, "name string, mark long").withColumn("hash", F.xxhash64("name")))
    distinct = units.groupBy("unit").agg(F.sum("n").alias("n"))
    n = F.length("unit")
    # the empty substring at the start keeps units without edges
    starts = distinct.select("unit", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    first = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.lit(1))
    spans = starts.select("unit", "n", "start", F.explode(F.sequence(first, F.least(F.lit(model.longest), n - F.col("start")))).alias("size"))
    named = spans.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size")))
    same = F.startswith("piece", "name") & F.startswith("name", "piece")
    lattice = named.withColumn("hash", F.xxhash64("piece")).join(table, "hash").where(same).select(
        "unit", "n",
        F.when(
            F.col("size") > 0,
            F.col("mark").bitwiseOR(F.call_function("shiftleft", F.col("start").cast("long"), F.lit(22))).bitwiseOR(
                F.call_function("shiftleft", (F.col("start") + F.col("size")).cast("long"), F.lit(16))
            ),
        ).alias("edge"),
    )
    edges = lattice.groupBy("unit").agg(F.first("n").alias("n"), F.collect_list("edge").alias("edges"))
    return edges.select("unit", "n", _folded(F.col("unit"), F.col("edges"), model.bytes[0]).alias("ids"))


def frequent_units(counts: DataFrame, model: Model) -> pa.Table:
    """The most frequent units of rows (unit, n) with their ids, at most DICTIONARY of them."""
    units = stash(counts.where(F.length("unit") <= FOLDED).groupBy("unit").agg(F.sum("n").alias("n")), "units")
    spread = sorted(units.groupBy("n").agg(F.count("*").alias("units")).collect(), reverse=True)
    room, least = DICTIONARY, None
    for n, k in spread:
        if k > room:
            break
        room, least = room - k, n
    chosen = units.where(F.col("n") >= least) if least is not None else units.limit(0)
    return encoded_units(chosen, model).select("unit", "ids").toArrow()


_dictionaries: dict[str, dict[str, bytes]] = {}
_met: dict[str, bytes] = {}
_odd: set[str] = set()  # units met whose ids decode to something else; none are known


def _tried(unit: str, ids: bytes, table: dict[int, bytes]) -> None:
    """Decode the ids of one unit, so that texts of units that give themselves again need not be decoded whole."""
    if b"".join([table.get(i, b"") for i in memoryview(ids).cast("i")]) != unit.replace(BAR, " ").encode("utf-8"):
        _odd.add(unit)


def _dictionary(shared, decoder: dict[int, bytes]) -> dict[str, bytes]:
    """The broadcast table as a dictionary, built and tried once per process; only the latest one is kept."""
    name, table = shared.value
    if name not in _dictionaries:
        _dictionaries.clear(), _met.clear(), _odd.clear()
        out = {}
        for batch in table.to_batches(max_chunksize=65_536):
            ids = batch.column(1)
            flat, at = ids.flatten().to_numpy().astype("<i4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            out.update((u, flat[at[k] : at[k + 1]].tobytes()) for k, u in enumerate(batch.column(0).to_pylist()))
        for unit, coded in out.items():
            _tried(unit, coded, decoder)
        _dictionaries[name] = out
    return _dictionaries[name]


def _rare(unit: str, model: Model, decoder: dict[int, bytes]) -> bytes:
    ids = _met.get(unit)
    if ids is None:
        ids = model.merged(unit)
        _tried(unit, ids, decoder)
        if len(unit) <= FOLDED:
            if len(_met) >= _MEMO:
                _met.clear()
            _met[unit] = ids
    return ids


def encoded(df: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ids (array of int), n_pieces and round_trip, whether decoding the ids gives the text again.

    NULL and empty texts have no pieces. Texts are encoded whole. A bar (U+2581) in a text decodes to a space, so
    round_trip is false there. Columns of those names are replaced, others stay except those in ``drop``. An empty
    table gives an empty result. Which units are in the dictionary changes the time, never the result.
    """
    model = Model(path)
    cols = [c for c in df.columns if c not in ("ids", "n_pieces", "round_trip")]
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("pieces", _dictionaries, _met, _odd)
        counts: Counter[str] = Counter()

        def flushed():
            often = [(u, n) for u, n in counts.items() if n > 1]  # once in a task is not often
            counts.clear()
            return pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in often], pa.string()), "n": pa.array([n for _, n in often], pa.int64())})

        for b in batches:
            for t in b.column(0):
                counts.update(model.units(t.as_py() or ""))
                if len(counts) > COUNTED:
                    yield flushed()
        yield flushed()

    counts = df.select(F.col(f"`{text}`")).mapInArrow(counted, "unit string, n long")
    shared = df.sparkSession.sparkContext.broadcast((uuid4().hex, frequent_units(counts, model)))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("pieces", _dictionaries, _met, _odd)
        table = model.decoder()
        known = _dictionary(shared, table)
        for b in batches:
            ids, good = [], []
            for t in b.column(at):
                t = t.as_py() or ""
                units = model.units(t)
                one = list(map(known.get, units))
                if None in one:
                    one = [x if x is not None else _rare(u, model, table) for x, u in zip(one, units, strict=True)]
                ids.append(np.frombuffer(b"".join(one), "<i4"))
                # decoding joins the bytes of the units, so units that give themselves again give all but bars
                good.append(decode(ids[-1].tolist(), table) == t if _odd else BAR not in t)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), flat, pa.array(good, pa.bool_())], names=[*(f"c{i}" for i in kept), "ids", "round_trip"])

    at, kept = cols.index(text), [i for i, c in enumerate(cols) if c not in drop]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    out = plain.mapInArrow(assembled, ", ".join([*(f"c{i} {types[cols[i]]}" for i in kept), "ids array<int>", "round_trip boolean"]))
    return out.select(*[F.col(f"c{i}").alias(cols[i]) for i in kept], "ids", F.size("ids").alias("n_pieces"), "round_trip")


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; NULL ids give NULL."""
    table = Model(path).decoder()
    cols = [c for c in df.columns if c != name]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    at = cols.index(ids)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if x is None else decode(x, table) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, "decoded"])

    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    out = plain.mapInArrow(texts, ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(cols)), "decoded string"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("decoded").alias(name))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids, round_trip."""
    return encoded(docs.select("doc_id", "text"), path, drop=("text",)).select("doc_id", "n_pieces", "ids", "round_trip")
