"""Uniform shuffle into shards of exact sizes, with a hypergeometric communication matrix.

Rows lie in P logical partitions. How many rows of each partition go to each shard is drawn first, from the exact
multivariate hypergeometric law given all partition and shard sizes. Rows are then permuted within their partition,
dealt to shards by those counts, and permuted again within their shard. Every assignment is equally likely, and
shard sizes are at most one apart. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import running_total, slices, stash


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it."""
    return F.transform(F.array(value), use)[0]


def _hypergeometric(pool: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked rows among ``drawn`` rows taken from ``pool``: inverse of the distribution at ``u``.

    Weights start at 1 on the left end and follow the ratio of neighbouring probabilities; beyond nine standard
    deviations from the mode they are below double precision.
    """
    n, k, d = (F.greatest(x, F.lit(0)).cast("double") for x in (pool, marked, drawn))
    safe = F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(d * (k / safe) * (1 - k / safe) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    reach = F.ceil(spread * 9) + 20
    low = F.greatest(F.lit(0).cast("long"), (d + k - n).cast("long"), mode - reach)
    high = F.least(d.cast("long"), k.cast("long"), mode + reach)

    def drawn_from(x: Column) -> Column:
        def ratio(i: Column) -> Column:
            return (x.k - i) * (x.d - i) / ((i + 1) * (x.n - x.k - x.d + i + 1))

        span = F.sequence(x.low, F.greatest(x.low, x.high))
        whole = F.aggregate(
            span,
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda a, i: F.struct((a.w * F.greatest(ratio(i.cast("double")), F.lit(0.0))).alias("w"), (a["sum"] + a.w).alias("sum")),
            lambda a: a["sum"],
        )
        return _let(
            x.u * whole,
            lambda aim: F.aggregate(
                span,
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), x.low.alias("at")),
                lambda a, i: F.struct(
                    (a.w * F.greatest(ratio(i.cast("double")), F.lit(0.0))).alias("w"),
                    (a["sum"] + a.w).alias("sum"),
                    F.when((a["sum"] <= aim) & (a.w > 0), i).otherwise(a["at"]).alias("at"),
                ),
                lambda a: a["at"],
            ),
        )

    fields = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), low.alias("low"), high.alias("high"), u.alias("u"))
    return _let(fields, drawn_from)


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def communication_matrix(sizes: DataFrame, total: int, levels: int, shards: int, seed: int) -> DataFrame:
    """Rows (part, counts): counts[s] rows of logical partition ``part`` go to shard s.

    ``sizes`` has (part, rows) for partitions 0 to 2^levels - 1; missing ones are empty. The counts of a range of
    partitions are split between its halves, level by level, so all nodes of a level are drawn in parallel.
    """
    spark = sizes.sparkSession
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = spark.range(1).select(
        F.col("id").alias("part"), F.array(*[F.lit(q).cast("long") for q in quota]).alias("counts")
    )
    for level in range(1, levels + 1):
        left = (
            sizes.withColumn("part", F.shiftright("part", levels - level))
            .where("part % 2 = 0")
            .groupBy(F.shiftright("part", 1).alias("part"))
            .agg(F.sum("rows").alias("left"))
        )
        both = nodes.join(left, "part", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long")))

        drawn = F.lit(level)

        def deal(a: Column, s: Column) -> Column:
            u = _uniform(F.lit(seed), drawn, F.col("part"), s)  # noqa: B023, the plan is built within the round
            take = _hypergeometric(a.pool, F.col("counts")[s], a.left, u)
            return _let(
                take,
                lambda t: F.struct(
                    (a.pool - F.col("counts")[s]).alias("pool"),
                    (a.left - t).alias("left"),
                    F.concat(a.out, F.array(t)).alias("out"),
                ),
            )

        start = F.struct(
            F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"),
            F.col("left"),
            F.array().cast("array<bigint>").alias("out"),
        )
        dealt = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, deal, lambda a: a.out)
        nodes = both.withColumn("dealt", dealt).select(
            F.explode(
                F.array(
                    F.struct((F.col("part") * 2).alias("part"), F.col("dealt").alias("counts")),
                    F.struct(
                        (F.col("part") * 2 + 1).alias("part"),
                        F.zip_with("counts", "dealt", lambda c, x: c - x).alias("counts"),
                    ),
                )
            ).alias("child")
        ).select("child.*")
        if level % 4 == 0:
            nodes = stash(nodes, "matrix")
    return nodes


def uniform_shards(df: DataFrame, identity: list[Column], shards: int = 16, seed: int = 20_240) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard), as a uniform shuffle.

    Row counts of shards differ by one at most. ``identity`` are columns that tell rows apart; they seed the
    permutations. Repeated rows are told apart by a drawn number, so any number of them spread evenly. NULLs are
    ordinary values, an empty table gives an empty result, and columns of ``df`` keep their names and values
    (``shard`` and ``slot`` are replaced if present). ``df`` should be narrow: its rows are exchanged three times.
    """
    named = [c for c in df.columns if c not in ("shard", "slot")]
    salted = F.floor(F.rand(seed) * 1024)
    rows = stash(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in named]).alias("row"),
            F.xxhash64(F.lit(seed), salted, *identity).alias("home"),
            F.xxhash64(F.lit(seed + 1), salted, *identity).alias("first"),
            F.xxhash64(F.lit(seed + 2), salted, *identity).alias("second"),
            F.rand(seed + 3).alias("tie"),
        ),
        "shuffle",
    )
    total = rows.count()
    parts = slices(total)
    levels = parts.bit_length() - 1
    rows = rows.withColumn("part", F.pmod("home", F.lit(parts).cast("long")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("rows"))
    matrix = communication_matrix(sizes, total, levels, shards, seed)
    bounds = matrix.select(
        "part",
        F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("bounds"),
    )
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("first", "tie")))
    dealt = stash(
        local.join(bounds, "part").select(
            "row", "second", "tie",
            F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("shard"),
            F.pmod(F.shiftright("second", 20), F.lit(parts).cast("long")).alias("cell"),
        ),
        "dealt",
    )
    slotted = running_total(dealt, ["shard"], "cell", ["second", "tie"], F.lit(1).cast("long"), "slot")
    return slotted.select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
