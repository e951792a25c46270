"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: how its share changes over the training
time 0..1.  The targets share the corpus' words by weight; none is above
``max_repeats`` times its source's size, and the excess is shared again by weight.
A source's documents stand in the order of a hash, repeated as often as the target
asks; a document's place in that line is its cumulative demand, and inverting the
integrated schedule at that demand gives its training position.

Defined cases: a null text has size 0; sources are ordered by code point, null last,
and null is a source of its own; an empty table gives no rows; a document that the
mix does not take has ``taken`` 0 and no position; rows repeated whole are
interchangeable.  Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, running_total

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: One schedule for each weight: (time, factor) knots, linear between them.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
)
OUTPUTS = ("size", "source_size", "target", "taken", "positions")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """63 bits of the id's MD5, which other engines compute alike."""
    return F.shiftleft(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), 3)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> plus rank, weight and target words; one row a source.

    With caps, the targets are least(cap, level * weight).  The level comes from the
    sources ordered by cap / weight: the first at which sharing what the caps before
    it leave does not pass its own cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("__rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("__weight", F.element_at(F.lit(list(weights)), F.pmod("__rank", F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("__cap", F.col("source_size") * max_repeats)
    by_cap = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    below, above = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    s = s.withColumn("__level", (total - F.coalesce(F.sum("__cap").over(below), F.lit(0))) / F.sum("__weight").over(above))
    s = s.withColumn("__fits", F.col("__level") <= F.col("__cap") / F.col("__weight"))
    level = F.min(F.when(F.col("__fits"), F.struct(F.col("__cap") / F.col("__weight"), F.col("__rank"), F.col("__level")))).over(everything).getField("__level")
    target = F.least(F.col("__cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("__weight"))
    return s.select("source", "source_size", "__rank", "__weight", target.alias("target"))


def invert_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` (0..1) of a schedule's integral has passed."""
    area = [0.0]
    for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (f0 + f1) / 2)
    want, out = share * F.lit(area[-1]), None
    for i in reversed(range(len(knots) - 1)):
        (t0, f0), (t1, f1) = knots[i], knots[i + 1]
        left = F.greatest(want - F.lit(area[i]), F.lit(0.0))
        slope = (f1 - f0) / (t1 - t0)
        # f0 * x + slope * x^2 / 2 = left, in the form that also holds for slope 0
        root = F.lit(f0) + F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * slope) * left, F.lit(0.0)))
        x = F.when(root > 0, F.lit(2.0) * left / root).otherwise(F.lit(0.0))
        here = F.lit(t0) + x
        out = here if out is None else F.when(want < F.lit(area[i + 1]), here).otherwise(out)
    return F.least(out, F.lit(float(knots[-1][0])))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add size, source_size, target, taken and positions (one for each repeat) to (doc_id, text, source) rows."""
    docs = docs.drop(*OUTPUTS).withColumns({"size": n_words(F.col("text")), "__h": document_hash(F.col("doc_id"))})
    return place(docs, weights, schedules, max_repeats)


def place(docs: DataFrame, weights: Sequence[int], schedules: Sequence[Sequence[tuple[float, float]]], max_repeats: int) -> DataFrame:
    """The same for rows that have a size and an order hash ``__h``."""
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats).withColumnRenamed("source", "__source")
    line = running_total(docs, "source", "__h", "size", "__at", ["doc_id", "size"])
    # one row a source: small beside the documents, and joined without a hint so its size decides
    line = line.join(goal, F.col("source").eqNullSafe(F.col("__source")))
    words = F.floor(F.col("target") + 0.5)
    steps = [F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("__at") - F.col("source_size") * p)) for p in range(max_repeats)]
    line = line.withColumn("taken", sum(steps[1:], steps[0]).cast("long"))
    spots = []
    for p, step in enumerate(steps):
        share = (F.col("__at") + F.col("source_size") * p) / F.col("target")
        kind = F.pmod("__rank", F.lit(len(schedules)))
        time = invert_schedule(share, schedules[-1])
        for i in reversed(range(len(schedules) - 1)):
            time = F.when(kind == i, invert_schedule(share, schedules[i])).otherwise(time)
        spots.append(F.when(step > 0, F.struct(time.alias("position"), step.cast("long").alias("words"))))
    line = line.withColumn("positions", F.filter(F.array(*spots), lambda x: x.isNotNull()))
    return line.drop("__h", "__at", "__source", "__rank", "__weight")


def ordered(mixed: DataFrame) -> DataFrame:
    """Mixed documents range-sorted by their first position; those not taken come last."""
    return mixed.withColumn("position", F.try_element_at("positions", F.lit(1)).getField("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each repeat, range-sorted by position; the last of a source may be cut.

    A cut text keeps its first words, joined by single spaces.
    """
    rows = mixed.select("*", F.explode("positions").alias("__p"))
    words = F.regexp_extract_all(F.col("text"), F.lit(SPACED_WORD), F.lit(0))
    text = F.when(F.col("__p.words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("__p.words").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).orderBy(F.col("__p.position"), "doc_id")
    return rows.withColumn("n_chars", F.length("text").cast(dict(mixed.dtypes).get("n_chars", "long"))).select(*columns)
