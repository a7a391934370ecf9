"""Feature sets compared by naive Bayes, all from one table of statistics.

Rows with the same values are one pattern with a count, and a pattern's mask says
which fields it has.  A run is a set of fields to use and a set of fields that rows
must have: it takes the patterns whose masks hold the second, so that all runs come
from the one table, without a fit of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwright.operators.tables import written


@dataclass(frozen=True)
class Run:
    name: str
    uses: tuple[str, ...]
    needs: tuple[str, ...]


def single(sets: dict[str, Sequence[str]]) -> list[Run]:
    """A run a set, on the rows that are complete in it."""
    return [Run(name, tuple(fields), tuple(fields)) for name, fields in sets.items()]


def compared(sets: dict[str, Sequence[str]], pairs: Sequence[tuple[str, str, str]]) -> list[Run]:
    """Two runs ``name/left`` and ``name/right`` for each (name, left, right), on the rows that are complete in both sets."""
    both = lambda a, b: tuple(dict.fromkeys([*sets[a], *sets[b]]))
    return [Run(f"{name}/{side}", tuple(sets[own]), both(a, b)) for name, a, b in pairs for side, own in (("left", a), ("right", b))]


def patterns(rows: DataFrame, fields: Sequence[str], label: str, test: Column) -> DataFrame:
    """test, class, the fields as text, mask, n: the distinct labelled rows, counted; written once."""
    text = rows.select(test.alias("test"), F.col(label).cast("string").alias("class"), *[F.col(f).cast("string").alias(f) for f in fields]).where("class IS NOT NULL AND test IS NOT NULL")
    mask = sum((F.when(F.col(f).isNotNull(), F.lit(1 << k)).otherwise(0) for k, f in enumerate(fields)), F.lit(0)).cast("long")
    return written(text.groupBy("test", "class", *fields).agg(F.count("*").alias("n")).withColumn("mask", mask))


def evaluate(stats: DataFrame, fields: Sequence[str], runs: Sequence[Run], least: int = 10, most_classes: int = 1000) -> DataFrame:
    """run, train_rows, rows, accuracy, majority_accuracy, delta, status of each run over ``patterns``.

    Counts are smoothed by 1 over the vocabulary and one more; equal scores, to nine digits,
    go to the smaller class, and so do equal counts of the majority's class.  Without
    rows on a side a run is ``insufficient-support``, with fewer than ``least`` it is ``privacy-limited``, and
    its measures are null.  A label of more than ``most_classes`` classes is an error.
    """
    spark, bit = stats.sparkSession, {f: 1 << k for k, f in enumerate(fields)}
    classes = [r[0] for r in stats.select("class").distinct().orderBy("class").limit(most_classes + 1).collect()]
    if len(classes) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("class")).cast("int") if classes else F.lit(0)
    choices = F.array(*[F.struct(F.lit(r.name).alias("run"), F.lit(sum(bit[f] for f in r.uses)).cast("long").alias("uses"), F.lit(sum(bit[f] for f in r.needs)).cast("long").alias("needs")) for r in runs])
    fits = F.filter(choices, lambda r: F.col("mask").bitwiseAND(r["needs"]) == r["needs"])
    # What a run does not use is dropped at once, so that small sets have few patterns.
    used = lambda f: F.when(F.col("uses").bitwiseAND(bit[f]) > 0, F.col(f)).alias(f)
    opened = stats.withColumn("class", code).select("test", "class", *fields, "n", F.inline(fits)).select("test", "class", "run", "n", *map(used, fields))
    opened = written(opened.groupBy("test", "class", "run", *fields).agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    cells = F.filter(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("v")) for k, f in enumerate(fields)]), lambda c: c["v"].isNotNull())
    train, test = opened.where("NOT test"), opened.where("test")

    totals = train.groupBy("run", "class").agg(F.sum("n").alias("nc"))
    of_class = lambda value, default: F.array(*[F.coalesce(F.max(F.when(F.col("class") == k, value)), F.lit(default)) for k in range(1, len(classes) + 1)]) if classes else F.array(F.lit(default))
    priors = totals.withColumn("all", F.sum("nc").over(Window.partitionBy("run"))).groupBy("run").agg(
        F.first("all").alias("train_rows"), of_class(F.log(F.col("nc") / F.col("all")), -1e300).alias("prior"),
        of_class(F.col("nc"), 0).alias("counts"), F.min(F.struct((-F.col("nc")).alias("n"), "class"))["class"].alias("major"),
    )
    counted = train.select("run", "class", "n", F.inline(cells)).groupBy("run", "f", "v", "class").agg(F.sum("n").alias("n")).groupBy("run", "f", "v").agg(of_class(F.col("n"), 0).alias("seen"))
    vocabulary = counted.groupBy("run", "f").agg(F.count("*").alias("vocab"))
    zeros = F.array(*[F.lit(0).cast("long") for _ in classes or [0]])
    asked = test.select("run", "id", F.inline(cells))
    weights = asked.select("run", "f", "v").distinct().join(vocabulary, ["run", "f"]).join(priors.select("run", "counts"), "run").join(counted, ["run", "f", "v"], "left")
    weights = weights.select("run", "f", "v", F.zip_with(F.coalesce("seen", zeros), "counts", lambda s, c: F.log((s + 1) / (c + F.col("vocab") + 1))).alias("w"))
    score = asked.join(weights, ["run", "f", "v"]).groupBy("run", "id").agg(F.array(*[F.sum(F.col("w")[k]) for k in range(max(1, len(classes)))]).alias("s"))
    found = test.select("run", "id", "class", "n").join(score, ["run", "id"]).join(priors.select("run", "prior", "major"), "run")
    total = F.zip_with("s", "prior", lambda s, p: F.round(s + p, 9))
    said = found.select("run", "class", "n", "major", F.array_position(total, F.array_max(total)).alias("said"))
    told = said.groupBy("run").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (("rows", F.lit(True)), ("right", F.col("class") == F.col("said")), ("usual", F.col("class") == F.col("major")))])
    every = spark.createDataFrame([(r.name,) for r in runs], "run string").join(priors.select("run", "train_rows"), "run", "left").join(told, "run", "left").fillna(0)
    status = F.when((F.col("train_rows") == 0) | (F.col("rows") == 0), "insufficient-support").when((F.col("train_rows") < least) | (F.col("rows") < least), "privacy-limited").otherwise("observed")
    share = lambda c: F.when(F.col("status") == "observed", F.round(F.col(c) / F.col("rows"), 6))
    out = every.withColumn("status", status).select("run", "train_rows", "rows", share("right").alias("accuracy"), share("usual").alias("majority_accuracy"), "status")
    return out.withColumn("delta", F.round(F.col("accuracy") - F.col("majority_accuracy"), 6))


def paired(results: DataFrame) -> DataFrame:
    """comparison, train_rows, rows, left_accuracy, right_accuracy, difference, status of the runs of ``compared``."""
    name, side = F.element_at(F.split("run", "/"), 1), F.element_at(F.split("run", "/"), 2)
    pick = lambda s, c: F.max(F.when(side == s, F.col(c)))
    out = results.groupBy(name.alias("comparison")).agg(F.max("train_rows").alias("train_rows"), F.max("rows").alias("rows"), pick("left", "accuracy").alias("left_accuracy"), pick("right", "accuracy").alias("right_accuracy"), F.max("status").alias("status"))
    return out.withColumn("difference", F.round(F.col("right_accuracy") - F.col("left_accuracy"), 6))
