"""Quality rules with risk-controlled cutoffs; DataFrame expressions only.

Each rule compares a ratio of the text, in 64 steps, with a cutoff. Labelled
documents choose it per stratum (language): a cutoff that rejects k of n good
ones is safe if, at a true false rejection rate of ``risk`` over the number
of rules, k or fewer would come with a chance of at most ``delta`` over
strata and rules (the exact binomial, or Clopper-Pearson, bound). Cutoffs are
tested from the loosest on, stopping at the first that fails, which needs no
further correction; over strata and rules the level is split (Bonferroni). Of
the safe ones, the one with the widest gap between bad and good documents
rejected is used; a rule without one rejects nothing in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, whole_row

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STEPS = 64
RULES = ("symbols", "bangs", "capitals", "repeated_lines", "repeated_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the steps of RULES and the columns named in ``carry``, per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), text.alias("t"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    held = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select(*carry, "doc_id", "stratum", "t", F.transform(words, lambda x: F.xxhash64(x)).alias("w"), held.alias("lines"))
    # words are hashed once, their windows by the words' hashes
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(5))))
    rows = rows.select(
        *carry,
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("t"), "!").cast("long").alias("n_bangs"),
        _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 5, grams).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    # places of windows found twice, from the windows sorted by hash; then the words that they cover
    placed = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed).otherwise(none)).drop("g")
    again = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]))
    rows = rows.withColumn("p", F.sort_array(F.transform(again, lambda x: x["p"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    more = lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).cast("long").alias("n"), x.alias("last"))
    rows = rows.withColumn("n_repeat_words", F.aggregate("p", start, more, lambda a: a["n"])).drop("s", "p")
    step = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(STEPS), F.floor(F.col(a) * STEPS / F.col(b)))).otherwise(0).cast("int")
    rows = rows.withColumns(
        {
            "symbols": step("n_symbols", "word_chars"),
            "bangs": step("n_bangs", "word_chars"),
            "capitals": step("n_capitals", "word_chars"),
            "repeated_lines": step("n_dup_lines", "n_lines"),
            "repeated_words": step("n_repeat_words", "n_words"),
        }
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term from logarithms."""
    k = F.least(k, n)
    odds = F.lit(p / (1 - p))
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("lp"), F.exp(first).alias("c"))

    def add(a: Column, j: Column) -> Column:
        lp = a["lp"] + F.ln((n - j + 1) / j * odds)
        return F.struct(lp.alias("lp"), (a["c"] + F.exp(lp)).alias("c"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add, lambda a: a["c"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff (a step; that or more is rejected), good, bad, good_rejected, bad_rejected, chance: a row for each rule in use.

    ``labels``: doc_id, quality (1 good, 0 bad, others and null unused; of
    several rows of a doc_id the lowest counts). Rows that fail the base rules
    don't count.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = measured.where(~F.col("base_failed")).select("doc_id", "stratum", *RULES).join(known, "doc_id")
    steps = held.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))).alias("x")).groupBy("stratum", "x.rule", "x.step")
    steps = cut(steps.agg(F.sum(F.col("quality").cast("long")).alias("g"), F.sum((1 - F.col("quality")).cast("long")).alias("b")))  # few rows; the measured ones are read once
    whole = Window.partitionBy("stratum", "rule")
    down = whole.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"good": F.sum("g").over(whole), "bad": F.sum("b").over(whole), "good_rejected": F.sum("g").over(down), "bad_rejected": F.sum("b").over(down)})
    strata = steps.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null"))).alias("strata"))
    tests = steps.where(F.col("step") > 0).crossJoin(F.broadcast(strata))  # one row
    limit = risk / len(RULES)
    chance = F.when(F.col("good_rejected") <= F.col("good") * limit, binomial_cdf(F.col("good_rejected"), F.col("good"), limit))
    safe = tests.withColumn("chance", chance).where((F.col("chance") <= F.lit(delta) / (F.col("strata") * len(RULES))) & (F.col("bad_rejected") > 0))
    gap = F.col("bad_rejected") / F.col("bad") - F.col("good_rejected") / F.col("good")
    best = safe.withColumn("gap", F.round(gap, 9)).where(F.col("gap") > 0).groupBy("stratum", "rule").agg(F.max(F.struct("gap", "step", "good", "bad", "good_rejected", "bad_rejected", "chance")).alias("best"))
    return best.select("stratum", "rule", F.col("best.step").alias("cutoff"), "best.good", "best.bad", "best.good_rejected", "best.bad_rejected", "best.chance")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``measures``, rejected_by (array of rule names) and kept, a row per row of ``docs``.

    Null or empty text: no words, so the base rules fail. Null lang: a stratum
    of its own. Null doc_id: never labelled. Repeated rows are judged alike,
    each counts in the holdout. No labels, or too few in a stratum: only the
    base rules reject there. Empty tables: no rows, no cutoffs. Other columns
    are ignored.
    """
    measured = cut(measures(docs, carry))
    by_stratum = cutoffs(measured, labels, risk, delta).groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES)).withColumnRenamed("stratum", "__stratum")
    # a stratum with cutoffs has many labelled documents, so its rows are few
    rows = measured.join(F.broadcast(by_stratum), measured["stratum"].eqNullSafe(by_stratum["__stratum"]), "left")
    hit = F.filter(F.array(*(F.when(F.col(r) >= F.col(f"__{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    rows = rows.withColumn("rejected_by", hit).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return rows.drop("__stratum", *(f"__{r}" for r in RULES))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns kept.

    Each row of a doc_id is judged by its own text and lang; repeated rows
    stay or go together. Null or empty texts go. Empty table: no rows. Rows go
    along with their measures through the checkpoint: no text is shuffled or
    sorted.
    """
    rows = docs.select("doc_id", "text", "lang", whole_row(docs).alias("__row"))
    return judge(rows, labels, risk, delta, ("__row",)).where("kept").select("__row.*")
