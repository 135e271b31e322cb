"""Mixing sources to target weights by Pareto order sampling.

Each document has its own expected number of copies, level * w, up to
``most``: w grows with its size (size / (size + half)), so short documents
have lower odds than long ones of their source, and the source's level makes
the expected words add up to its target. The whole part of that number is
certain. The rest is an inclusion probability p: a document's rank is its
random odds u / (1 - u) over its inclusion odds p / (1 - p), and each source
takes the smallest ranks until the words that it still needs are reached as
nearly as possible: the sample's size is fixed, in words. Ranks are summed by
cell first, so only the cell in which a source's sample ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

CELLS = 1 << 14
UNIT = 1 << 20
SMALL = 64 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess is reshared by weight: target = min(cap, level * w)
    with the level at which the targets add up. One row a source in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "place": F.row_number().over(by),
            "capped": F.sum("cap").over(upto) - F.col("cap"),
            "open": F.sum("w").over(onwards),
            "all": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    rows = rows.withColumn("level", (F.col("all") * F.lit(float(share)) - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    return rows.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("w")), "cap").alias("target"))


def _weight(half: int) -> Column:
    """A document's weight in units of 1 / UNIT: whole numbers, so that sums are exact."""
    return F.expr(f"size * {UNIT}L div (size + {half}L)")


def _expected(most: float, half: int) -> Column:
    return F.coalesce(F.least(F.lit(float(most)), F.col("level") * _weight(half)), F.lit(float(most)))


def levels(sizes: DataFrame, goal: DataFrame, most: float, half: int) -> DataFrame:
    """(source, source_size, target, level, needed) from (source, size, n) and ``targets``.

    Of a source's sizes the largest reach ``most`` copies first; the level is
    that at which the expected words add up to the target, null where every
    document has ``most``. ``needed``: the target without the certain copies.
    A source's distinct sizes, at most the words of its longest text, meet in
    one task.
    """
    rows = sizes.withColumnRenamed("source", "__source").join(goal, F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
    rows = rows.withColumn("words", F.col("n") * F.col("size")).withColumn("w", _weight(half))
    by = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    heavy = F.col("words").cast("decimal(20,0)") * F.col("w").cast("decimal(10,0)")
    capped = (F.sum("words").over(upto) - F.col("words")) * F.lit(float(most))
    open_ = F.sum(heavy).over(onwards).cast("double")
    rows = rows.withColumns({"place": F.row_number().over(by), "open": open_, "capped": capped})
    rows = rows.withColumn("at", F.when(F.col("open") > 0, (F.col("target") - F.col("capped")) / F.col("open")))
    fits = F.when(F.col("at") * F.col("w") <= F.lit(float(most)), F.struct("place", "at"))
    rows = rows.withColumn("level", F.min(fits).over(Window.partitionBy("source"))["at"])
    certain = F.sum(F.floor(_expected(most, half)) * F.col("words"))
    rows = rows.groupBy("source", "source_size", "target", "level").agg(certain.alias("certain"))
    return rows.select("source", "source_size", "target", "level", (F.col("target") - F.col("certain")).alias("needed"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, half: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, certain, p, copies, taken (words; ``copies`` times ``size``), a row per row of ``docs``.

    ``p`` is the chance of one copy more than the ``certain`` ones. ``half``: the
    size at which a document's weight is half of the largest possible one; 0
    gives all documents of a source the same odds.

    Random numbers come from the md5 of seed and doc_id, so reruns agree; rows
    of one doc_id share theirs. Null source: a source of its own, last. Null
    or wordless text: size 0, taken 0. Null doc_id: counts as the text
    "null". A source's taken words differ from its target by at most half of
    one document, the one at which its sample ends. Repeated rows count each;
    ties of rank go by random number, doc_id, size. Empty table: no rows.
    Other columns are ignored.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), bits.alias("bits")))
    sizes = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    goal = cut(levels(sizes, goal, most, half).withColumnRenamed("source", "__source"))
    few = goal.count() * 100 <= SMALL
    rows = sized.join(F.broadcast(goal) if few else goal, sized["source"].eqNullSafe(goal["__source"])).drop("__source")
    expected = _expected(most, half)
    rows = rows.withColumn("certain", F.floor(expected)).withColumn("p", expected - F.col("certain"))
    u = (F.col("bits") + F.lit(0.5)) / F.lit(float(2**48))
    rank = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.withColumn("rank", rank).withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS)))
    # the cell in which each source's sample ends, and the words before it
    cells = rows.where("rank is not null").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("needed").alias("needed"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("upto", upto).where(F.col("upto") > F.col("needed"))
    ends = cells.groupBy("source").agg(F.min(F.struct("cell", F.col("upto") - F.col("words"))).alias("end"))
    ends = ends.select(F.col("source").alias("__source"), F.col("end.cell").alias("end"), F.col("end.col2").alias("before"))
    rows = rows.join(F.broadcast(ends) if few else ends, rows["source"].eqNullSafe(ends["__source"]), "left").drop("__source")
    rows = rows.withColumn("sure", F.when(F.col("rank").isNull(), 0).when(F.col("end").isNull() | (F.col("cell") < F.col("end")), 1).when(F.col("cell") > F.col("end"), 0))
    plain = rows.where(F.col("sure").isNotNull()).withColumn("picked", F.col("sure"))
    order = Window.partitionBy("source").orderBy("rank", "bits", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where(F.col("sure").isNull()).withColumn("before", F.col("before") + F.sum("size").over(order) - F.col("size"))
    last = last.withColumn("picked", F.when(2 * (F.col("needed") - F.col("before")) >= F.col("size"), 1).otherwise(0))
    copies = (F.col("certain") + F.col("picked")).cast("long")
    both = plain.union(last.select(plain.columns))
    return both.select("doc_id", "source", "size", "source_size", "target", F.col("certain").cast("long").alias("certain"), "p", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
