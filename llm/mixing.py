"""Mixing sources to target weights with a low-discrepancy schedule.

Slots 0 to K - 1 carry the points frac((k + 1) * golden ratio). A point falls into the cumulative weights of the
sources, which names the slot's source, and slots are ranked per source. Each source's documents are shuffled, laid
end to end, starting over after the last one, up to the source's target. What that gives is cut into as many blocks as
the source has slots, equal to one word; the slot of rank r takes block r. So every source ends at its target, rounded
to whole words, however long the blocks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import key_of, running_total, slices, stash, words

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)  # by source in code-point order, repeating
SHARE = 1.5  # of all words
MOST = 2  # passes over a source
SLOTS = 1 << 20
SEED = 77


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows (key, source, source_size), one per source.

    Sources by code point, NULL last, take ``weights`` in turn. Where a target would exceed ``most`` times its
    source it stops there and the excess goes to the others by weight: target = min(cap, weight * level), with the
    level found from running sums in the order in which sources reach their caps.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int"))
    filled = Window.orderBy("_reach", "_i")
    rows = (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * most)
        .withColumn("_reach", F.col("_cap") / F.col("_w"))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_level", (F.col("_all") * F.lit(share) - F.col("_full")) / F.col("_rest"))
        .withColumn(
            "_found",
            F.min(F.when(F.col("_cap") >= F.col("_w") * F.col("_level"), F.struct("_reach", "_i", "_level"))).over(whole),
        )
    )
    level = F.coalesce(F.col("_found")["_level"], F.lit(float("inf")))
    return rows.withColumn("target", F.least(F.col("_cap"), F.col("_w") * level)).drop(
        "_i", "_w", "_cap", "_reach", "_full", "_rest", "_all", "_level", "_found"
    )


def schedule(shares: DataFrame, total: float, block: int) -> tuple[DataFrame, dict[str, int]]:
    """Rows (slot, key, rank), the source of each slot and its rank among the slots of that source; slots per source.

    ``shares`` has (key, target). The cumulative weights of all sources stand in one array beside each slot; sources
    are few, documents are not. A source with a target that no point falls on gets a slot after the last one.
    """
    spark = shares.sparkSession
    n = max(1, round(total / block))
    up_to = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ladder = [(r.key, r.top) for r in shares.where("target > 0").select("key", F.sum("target").over(up_to).alias("top")).collect()]
    if not ladder:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit("").alias("key"), F.col("id").alias("rank")), {}
    top = ladder[-1][1]
    point = F.col("slot") * F.lit(GOLDEN) + F.lit(GOLDEN)
    at = (point - F.floor(point)) * F.lit(float(top))
    tops = F.array(*[F.lit(float(t)) for _, t in ladder[:-1]]).cast("array<double>")
    keys = F.array(*[F.lit(k) for k, _ in ladder])
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("key", F.element_at(keys, F.size(F.filter(tops, lambda t: t <= at)) + 1))
    counts = {r.key: r.n for r in slots.groupBy("key").agg(F.count("*").alias("n")).collect()}
    missed = [k for k, _ in ladder if k not in counts]
    if missed:
        names = F.array(*[F.lit(k) for k in missed])
        slots = slots.union(spark.range(len(missed)).select(F.col("id") + n, F.element_at(names, (F.col("id") + 1).cast("int"))))
    ranked = running_total(slots.withColumn("part", F.shiftright("slot", 12)), ["key"], "part", ["slot"], F.lit(1).cast("long"), "rank")
    return ranked.select("slot", "key", "rank"), counts | dict.fromkeys(missed, 1)


def mix(df: DataFrame, identity: list[Column], size: Column, source: Column, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``df`` as two tables: its distinct rows and the pieces that slots take.

    Rows: (ident, copies, key, source, size, source_size, target, start), where equal identity, size and source make
    one row with a number of copies, lying one after the other from word ``start`` of their source. Pieces: (ident,
    copy, pass, slot, first, last), words first to last - 1 of that copy. The usual block length follows from the total,
    so ``slots`` and the number of sources bound the schedule at any size. Documents without words are never taken; NULL sources are a source of
    their own; an empty table gives empty results.
    """
    rows = stash(
        df.select(F.xxhash64(F.lit(seed), *identity, source).alias("ident"), F.struct(*identity).alias("id"), source.alias("source"), size.cast("long").alias("size"))
        .groupBy("ident", "id", "source", "size")
        .agg(F.count("*").alias("copies"))
        .withColumn("key", key_of(F.col("source"))),
        "mix",
    )
    shares = stash(
        targets(rows.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))), "shares"
    )
    total, n = shares.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0], rows.count()
    block = max(1, -(-int(total) // slots))
    parts = slices(n)
    placed = running_total(
        rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "ident"), F.lit(parts).cast("long"))),
        ["key"], "part", ["ident", "id", "size"], F.col("size") * F.col("copies"), "start",
    )
    rows = stash(placed.join(shares.select("key", "source_size", "target"), "key").drop("part"), "placed")
    slotted, counts = schedule(shares, total, block)
    # of the words up to the target, the first ``longer`` slots take ``each`` + 1 and the others ``each``
    source_slots = df.sparkSession.createDataFrame(sorted(counts.items()), "key string, slots long")
    words_of = shares.select("key", F.round("target").cast("long").alias("goal")).join(source_slots, "key")
    words_of = words_of.select("key", "goal", F.expr("goal div slots").alias("each"), F.expr("goal % slots").alias("longer"))
    rank_at = "CASE WHEN {0} < longer * (each + 1) THEN {0} div (each + 1) ELSE longer + ({0} - longer * (each + 1)) div greatest(each, 1) END"
    start_of = "{0} * each + least({0}, longer)"
    cut = (
        rows.where("size > 0")
        .join(words_of, "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOST - 1).cast("long"))))
        .withColumn("begin", F.col("pass") * F.col("source_size") + F.col("start") + F.col("copy") * F.col("size"))
        .where("begin < goal")
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("goal")))
        .withColumn("rank", F.explode(F.sequence(F.expr(rank_at.format("begin")), F.expr(rank_at.format("(end - 1)")))))
    )
    taken = cut.join(slotted, ["key", "rank"])
    pieces = taken.select(
        "ident", "id", "source", "size", "copy", "pass", "slot",
        F.greatest(F.expr(start_of.format("rank")) - F.col("begin"), F.lit(0)).alias("first"),
        (F.least(F.expr(start_of.format("(rank + 1)")), F.col("end")) - F.col("begin")).alias("last"),
    )
    return rows, pieces


def taken_words(df: DataFrame) -> DataFrame:
    """Per document of (doc_id, text, source): size, source_size, target and taken, words the mix takes.

    NULL texts have size 0. Repeated rows each have their own line.
    """
    rows, pieces = mix(df, [F.col("doc_id"), F.xxhash64("text")], F.size(words(F.col("text"))), F.col("source"))
    counts = pieces.groupBy("ident", "id", "source", "size", "copy").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    same = (
        (F.col("e.ident") == F.col("c.ident")) & (F.col("e.copy") == F.col("c.copy")) & F.col("e.id").eqNullSafe(F.col("c.id"))
        & (F.col("e.size") == F.col("c.size")) & F.col("e.source").eqNullSafe(F.col("c.source"))
    )
    joined = each.alias("e").join(counts.alias("c"), same, "left")
    return joined.select(
        F.col("e.id.doc_id").alias("doc_id"), "e.size", "e.source_size", F.col("e.target").alias("target"), F.coalesce("c.taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: one row per pass over a document, all columns kept.

    A document that the last slots of its source take in part keeps the words they take, with the white space
    between them. Documents outside the mix and documents without words do not appear. A row taken twice appears
    twice.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    identity = [F.col("doc_id"), F.xxhash64(*cols)]
    size = F.size(words(F.col("text")))
    _, pieces = mix(docs, identity, size, F.col("source"))
    at = ["ident", "id"]
    takes = (
        pieces.groupBy(*at, "size", "copy", "pass")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy(*at, "size")
        .agg(F.collect_list(F.struct("first", "last")).alias("takes"))
    )
    named = F.xxhash64(F.lit(SEED), *identity, F.col("source")).alias("ident"), F.struct(*identity).alias("id")
    one = docs.select(*named, F.struct(*cols).alias("row")).groupBy(*at).agg(F.first("row").alias("row"))
    same = (F.col("o.ident") == F.col("t.ident")) & F.col("o.id").eqNullSafe(F.col("t.id"))
    every = one.alias("o").join(takes.alias("t"), same).select("row", "size", F.explode("takes").alias("take"))
    text = F.col("row.text")
    tokens = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    part = F.array_join(F.slice(tokens, (F.col("take.first") + 1).cast("int"), (F.col("take.last") - F.col("take.first")).cast("int")), "")
    cut = F.regexp_replace(part, r"[\x20\x09-\x0D]+$", "")
    kept = F.when((F.col("take.first") == 0) & (F.col("take.last") == F.col("size")), text).otherwise(cut)
    return every.select(*[(kept if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
