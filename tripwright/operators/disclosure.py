"""Counts of a whole profile, hidden where they are small and where others would give them away.

A profile's counts are a forest: the rows of a table fall into the present and the missing values
of each column, the present ones into categories, into years, these into months, and so on, in every
section.  Each family of counts adds up to its parent, so a hidden count can come back by
subtraction along any of these sums, across sections.  What is determined by the counts
shown is found by exact elimination, and more is hidden until nothing is.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwright.functions.bands import K

CELL = ["scope", "section", "family", "cell", "parent"]
#: The one count that has no parent.
ROWS = "rows"


def cells(frame: DataFrame, scope: str, spec: Iterable[tuple[str, str, Column | str, Column | str]]) -> DataFrame:
    """scope, section, family, cell, parent, n of ``(section, family, cell, parent)``; each row of ``frame`` falls into at most one cell of a family.

    A null cell or parent is none.  Cells are named uniquely within a scope.  The frame is read once, and only counts are shuffled.
    """
    text = lambda c: F.lit(c) if isinstance(c, str) else c.cast("string")
    every = [("tables", ROWS, ROWS, None), *spec]
    found = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("family"), text(c).alias("cell"), (F.lit(None).cast("string") if p is None else text(p)).alias("parent")) for s, f, c, p in every])
    kept = F.filter(found, lambda x: x["cell"].isNotNull() & (x["parent"].isNotNull() | (x["family"] == ROWS)))
    return frame.select(F.inline(kept)).groupBy("section", "family", "cell", "parent").agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), *CELL[1:], "n")


def column_cells(name: str, kind: str, book: list[str] | None = None) -> list[tuple[str, str, Column, Column | str]]:
    """The cells of one column in the sections of its kind: ``text``, ``category``, ``number`` or ``date``; with ``book`` also whether its codes are in it."""
    c, there = F.col(name), f"{name}=present"
    if kind == "number":
        there_is = c.isNotNull()
    else:
        there_is = c.isNotNull() if kind == "date" else F.btrim(c.cast("string")) != ""
    present = F.when(F.coalesce(there_is, F.lit(False)), there)
    cell = lambda label, value: F.when(present.isNotNull(), F.concat(F.lit(f"{name}{label}="), value))
    out: list[tuple[str, str, Column, Column | str]] = [("columns", f"columns/{name}", F.coalesce(present, F.lit(f"{name}=missing")), ROWS)]
    if kind in ("text", "category"):
        blank = F.when(present.isNull(), F.when(c.isNull(), f"{name} null").otherwise(f"{name} blank"))
        out.append(("blanks", f"blanks/{name}", blank, f"{name}=missing"))
        size = F.length(c.cast("string"))
        out.append(("length_bands", f"length_bands/{name}", cell(" length", F.when(size < 8, "1-7").when(size < 16, "8-15").otherwise("16+")), there))
    if kind == "category":
        out.append(("categorical_values", f"categorical_values/{name}", cell("", F.concat(F.lit(":"), c.cast("string"))), there))
    if kind == "number":
        sign = F.when(F.isnan(c.cast("double")), "non-finite").when(c < 0, "negative").when(c == 0, "zero").otherwise("positive")
        out.append(("numeric_summary", f"numeric_summary/{name}", cell(" sign", sign), there))
        size = F.when(F.abs(c) < 10, "<10").when(F.abs(c) < 1000, "10-999").otherwise("1000+")
        out.append(("numeric_bands", f"numeric_bands/{name}", cell(" size", size), there))
    if kind == "date":
        year = cell(" year", F.date_format(c, "yyyy"))
        out.append(("date_years", f"date_years/{name}", year, there))
        out.append(("date_months", f"date_months/{name}", cell(" month", F.date_format(c, "yyyy-MM")), year))
    if book is not None:
        out.append(("codebook_check", f"codebook_check/{name}", cell(" book", F.when(c.cast("string").isin(*book), "in").otherwise("out")), there))
    return out


def determined(hidden: Iterable[int], equations: list[dict[int, int]]) -> set[int]:
    """The hidden cells that the equations fix once all others are known: those whose unit vector lies in the row space."""
    columns, rows = sorted(set(hidden)), []
    for e in equations:
        if row := {c: Fraction(v) for c, v in e.items() if c in set(columns)}:
            rows.append(row)
    pivots: dict[int, dict[int, Fraction]] = {}
    for row in rows:
        for p, own in pivots.items():
            if f := row.get(p):
                row = {c: v for c in {*row, *own} if (v := row.get(c, Fraction(0)) - f * own.get(c, Fraction(0)))}
        if not row:
            continue
        p = min(row)
        row = {c: v / row[p] for c, v in row.items()}
        for q, own in pivots.items():
            if f := own.get(p):
                pivots[q] = {c: v for c in {*own, *row} if (v := own.get(c, Fraction(0)) - f * row.get(c, Fraction(0)))}
        pivots[p] = row
    return {p for p, row in pivots.items() if len(row) == 1}


def protect(n: list[int], equations: list[dict[int, int]], k: int = K, start: Iterable[int] = ()) -> dict[int, str]:
    """What to hide of the counts ``n``, and why: ``small``, those of ``start`` ``kept``, and ``complement``.

    Where a hidden count is determined, or the hidden parts of a shown total come to less than ``k``,
    the smallest shown count of one of its sums is hidden too, the first of equals; zeros only where
    nothing else is left.
    """
    hidden = {i: "small" for i, x in enumerate(n) if 0 < x < k}
    hidden |= {i: "kept" for i in start if i not in hidden}
    of: dict[int, list[int]] = {}
    for e, row in enumerate(equations):
        for c in row:
            of.setdefault(c, []).append(e)

    def more(rows: Iterable[int]) -> bool:
        choice = min(((n[c] == 0, n[c], c) for e in rows for c in equations[e] if c not in hidden), default=None)
        if choice is None:
            return False
        hidden[choice[2]] = "complement"
        return True

    while True:
        thin = [e for e, row in enumerate(equations) if (own := [c for c, v in row.items() if v < 0 and c in hidden]) and sum(n[c] for c in own) < k and any(v > 0 and c not in hidden for c, v in row.items())]
        if any(more([e]) for e in thin):
            continue
        known = determined(hidden, equations)
        if not any(more(of.get(c, ())) for c in sorted(known)):
            return hidden


def _protector(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["section", "family", "cell"], ignore_index=True)
        place = {c: i for i, c in enumerate(group["cell"])}
        equations: dict[str, dict[int, int]] = {}
        for i, (family, parent) in enumerate(zip(group["family"], group["parent"])):
            if parent is not None and parent in place:
                equations.setdefault(f"{family}|{parent}", {place[parent]: 1})[i] = -1
        kept = np.flatnonzero(group["hidden"].to_numpy(bool)).tolist()
        found = protect(group["n"].tolist(), list(equations.values()), k, kept)
        return group.assign(reason=[found.get(i) for i in range(len(group))])[[*CELL, "n", "reason"]]

    return run


def protected(counts: DataFrame, k: int = K) -> DataFrame:
    """scope, section, family, cell, parent, n, reason of all ``cells``; a count with a reason must not be shown.

    A scope is protected at once, by one task: it is the profile of one table, whose
    size its columns and their listed values bound.  ``counts`` may say in ``hidden`` what was hidden before and stays so.
    """
    known = counts if "hidden" in counts.columns else counts.withColumn("hidden", F.lit(False))
    return known.groupBy("scope").applyInPandas(_protector(k), "scope string, section string, family string, cell string, parent string, n long, reason string")


def refreshed(before: DataFrame, section: str, counts: DataFrame, k: int = K) -> DataFrame:
    """``before``, a protected profile with its counts, with one section counted anew.

    What other sections hid stays hidden, and they hide more where the new section would
    give something away; scopes without new counts keep their section.
    """
    new = counts.where(F.col("section") == section).select(*CELL, "n")
    known = new.select("scope").distinct().withColumn("_new", F.lit(True))
    old = before.join(known, "scope", "left").where((F.col("section") != section) | F.col("_new").isNull())
    rows = old.select(*CELL, "n", F.col("reason").isNotNull().alias("hidden")).unionByName(new.withColumn("hidden", F.lit(False)))
    return protected(rows, k)


def published(profile: DataFrame) -> DataFrame:
    """scope, section, family, cell, value: the counts, or ``<suppressed>``."""
    return profile.select("scope", "section", "family", "cell", F.when(F.col("reason").isNull(), F.col("n").cast("string")).otherwise("<suppressed>").alias("value"))
