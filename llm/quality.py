"""Quality rules with adaptive thresholds per language and source.

Each document gets integer rates. A quantile sketch per (language, source) counts documents per bin of a rate: bins
are single values up to 127 and keep seven leading bits above, so a quantile is exact to one part in 64. Such
sketches merge by adding counts, in any order and with equal results, so Spark merges them as partial aggregates.
Thresholds are fences around the quartiles of a group's sketch; sketches of groups with few documents are merged into
their language's sketch, and those of small languages into that of all documents. Documents are then joined with the
thresholds of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORDS, key_of, stash

SYMBOLS = frozenset("#*$%&|<>")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: rate -> (least width above the upper quartile, whether low values are fenced too)
RATES = {"symbol_rate": (60, False), "dup_line_rate": (350, False), "repeat_rate": (200, False), "word_length": (400, True)}
FENCE = 4  # times the distance between the quartiles
LEAST_DOCUMENTS = 200  # of a group with thresholds of its own

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def count_text(text: str | None) -> tuple[int, ...]:
    """The figures of COUNTS for one text; all 0 for NULL and empty texts."""
    if not text:
        return (0,) * len(COUNTS)
    found = WORDS.findall(text)
    n = len(found)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    grams = list(zip(found, found[1:], found[2:], found[3:], found[4:], strict=False))
    if len(set(grams)) < len(grams):
        once, twice = set(), set()
        for g in grams:
            (twice if g in once else once).add(g)
        last = -1
        for i, g in enumerate(grams):
            if g in twice:
                repeated += i + 5 - max(i, last)
                last = i + 5
    return n, sum(map(len, found)), sum(text.count(c) for c in SYMBOLS), lines, dup, repeated


def _counted(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [count_text(t.as_py()) for t in batch.column(at)]
        figures = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(f, pa.int64()) for f in figures)],
            names=[*batch.schema.names, *(f"_{c}" for c in COUNTS)],
        )


def bin_of(value: Column) -> Column:
    """Lower edge of a value's bin."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., rate, bin, n): documents per bin. Documents without words take no part."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bin_of(F.col(r)).alias("bin")) for r in RATES]))
    return rows.where("_n_words > 0").select(*by, each.alias("at")).select(*by, "at.*").groupBy(*by, "rate", "bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., rate, docs, q1, q3): the smallest bins with a quarter and three quarters of the documents."""
    at = Window.partitionBy(*by, "rate")
    cum = sketch.withColumn("below", F.sum("n").over(at.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "docs", F.sum("n").over(at)
    )
    return cum.groupBy(*by, "rate").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("below") * 4 >= F.col("docs"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("below") * 4 >= F.col("docs") * 3, F.col("bin"))).alias("q3"),
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """Rows (_lang, _source, low_<rate>, high_<rate>...): the fences of each group of (language, source)."""
    fine = stash(sketches(rows, ["_lang", "_source"]), "sketch")
    middle = fine.groupBy("_lang", "rate", "bin").agg(F.sum("n").alias("n"))
    coarse = middle.groupBy("rate", "bin").agg(F.sum("n").alias("n"))
    own = quartiles(fine, ["_lang", "_source"])
    lang = quartiles(middle, ["_lang"]).select("_lang", "rate", *[F.col(c).alias(f"lang_{c}") for c in ("docs", "q1", "q3")])
    every = quartiles(coarse, []).select("rate", *[F.col(c).alias(f"all_{c}") for c in ("q1", "q3")])
    joined = own.join(lang, ["_lang", "rate"]).join(every, "rate")

    def chosen(q: str) -> Column:
        return (
            F.when(F.col("docs") >= LEAST_DOCUMENTS, F.col(q))
            .when(F.col("lang_docs") >= LEAST_DOCUMENTS, F.col(f"lang_{q}"))
            .otherwise(F.col(f"all_{q}"))
        )

    fences = []
    fenced = joined.withColumn("q1", chosen("q1")).withColumn("q3", chosen("q3"))
    for rate, (least, both) in RATES.items():
        reach = F.greatest((F.col("q3") - F.col("q1")) * FENCE, F.lit(least))
        mine = F.col("rate") == rate
        fences.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"high_{rate}"))
        if both:
            fences.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"low_{rate}"))
    return fenced.groupBy("_lang", "_source").agg(*fences)


def judged(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a struct ``_quality`` of counts, base_failed and kept, one row per row.

    NULL and empty texts have no words and fail. NULL languages and sources are groups of their own. Repeated rows
    count as often as they occur. Other columns, whatever their names, stay as they are; ``drop`` names columns not
    wanted in the result. An empty table gives an empty result.
    """
    cols = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at = cols.index(text)
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema)), *(f"_{c} bigint" for c in COUNTS)])
    counted = plain.mapInArrow(lambda batches: _counted(batches, at), schema)
    kept_cols = [f"c{i}" for i, c in enumerate(cols) if c not in drop]
    n = F.greatest(F.col("_n_words"), F.lit(1))
    rows = stash(
        counted.select(
            *kept_cols,
            *[f"_{c}" for c in COUNTS],
            key_of(F.col(f"c{cols.index(lang)}")).alias("_lang"),
            key_of(F.col(f"c{cols.index(source)}")).alias("_source"),
            F.floor(F.col("_n_symbols") * 1000 / n).alias("symbol_rate"),
            F.floor(F.col("_n_dup_lines") * 1000 / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_line_rate"),
            F.floor(F.col("_n_repeat_words") * 1000 / n).alias("repeat_rate"),
            F.floor(F.col("_word_chars") * 100 / n).alias("word_length"),
        ),
        "counted",
    )
    limits = thresholds(rows)
    failed = (F.col("_n_words") < MIN_WORDS) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEAT_PERCENT)
    inside = F.lit(True)
    for rate, (_, both) in RATES.items():
        inside = inside & (F.col(rate) <= F.col(f"high_{rate}"))
        if both:
            inside = inside & (F.col(rate) >= F.col(f"low_{rate}"))
    figures = [F.col(f"_{c}").alias(c) for c in COUNTS] + [F.col(r) for r in RATES]
    return rows.join(limits, ["_lang", "_source"], "left").select(
        *[F.col(k).alias(c) for k, c in zip(kept_cols, [c for c in cols if c not in drop], strict=True)],
        F.struct(*figures, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept")).alias("_quality"),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return judged(docs).where("_quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
