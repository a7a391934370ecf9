"""Checks of code books, run settings and snapshots against what a run was told."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.functions.text import clean
from tripwright.operators.rankmodel import OBJECTIVES
from tripwright.operators.training import ContractError, feature_columns, feature_value

STRATEGIES = ("uniform", "popularity-weighted", "mixed", "hard")


def book_problems(book: DataFrame, wanted: DataFrame, cohorts: DataFrame) -> DataFrame:
    """problem, code: how ``book(code, label)`` departs from ``wanted(code, label)``, and its codes from ``cohorts(cohort, code)``.

    ``missing`` and ``unexpected`` codes, a ``label_mismatch``, a ``conflicting_label`` where the
    book gives a code two labels, a code of several cohorts (``cohort_overlap``) or of none
    (``outside_cohorts``).  Blank codes are none.  No row means that the book is verified.
    """
    rows = book.select(clean(F.col("code")).alias("code"), F.coalesce(clean(F.col("label")), F.lit("")).alias("label")).where("code IS NOT NULL")
    own = rows.groupBy("code").agg(F.collect_set("label").alias("labels"))
    both = own.join(wanted.select("code", F.col("label").alias("wanted")).distinct(), "code", "full")
    groups = cohorts.groupBy("code").agg(F.count_distinct("cohort").alias("cohorts"))
    both = both.join(groups, "code", "left")
    there, asked = F.col("labels").isNotNull(), F.col("wanted").isNotNull()
    found = F.array_compact(F.array(
        F.when(~there, "missing"), F.when(~asked, "unexpected"), F.when(there & asked & ~((F.size("labels") == 1) & F.array_contains("labels", F.col("wanted"))), "label_mismatch"),
        F.when(F.size("labels") > 1, "conflicting_label"), F.when(there & F.col("cohorts").isNull(), "outside_cohorts"),
    ))
    overlap = groups.where("cohorts > 1").select(F.lit("cohort_overlap").alias("problem"), "code")
    return both.select(F.explode(found).alias("problem"), "code").unionByName(overlap)


@dataclass(frozen=True)
class RunConfig:
    """The settings of a ranking run; ``groups`` name the feature groups that it uses."""

    groups: tuple[str, ...]
    strategy: str = "uniform"
    ratio: int = 1
    objective: str = "lambda"
    seed: int = 1
    ks: tuple[int, ...] = (5, 10, 20)
    depth: int = 3
    popularity: str = "raw"
    rounds: int = 1000
    smoothing: float = 1.0
    uniform: float = 0.5
    known: Mapping[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        wrong = {
            "objective": self.objective not in OBJECTIVES, "strategy": self.strategy not in STRATEGIES, "ratio": self.ratio <= 0, "ks": not self.ks or min(self.ks) <= 0, "groups": not self.groups or not set(self.groups) <= set(self.known),
            "depth": self.depth not in (1, 2, 3), "popularity": self.popularity not in ("raw", "log1p"), "rounds": self.rounds <= 0, "smoothing": not math.isfinite(self.smoothing) or self.smoothing < 0, "uniform": not 0 <= self.uniform <= 1,
        }
        if any(wrong.values()):
            raise ContractError(f"settings out of bounds: {sorted(k for k, w in wrong.items() if w)}")

    def protocol(self) -> dict:
        """All settings, and a fingerprint of them that their order does not change."""
        settings = {k: v for k, v in asdict(self).items() if k != "known"}
        return settings | {"sha256": hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()}

    def prepared(self, frame: DataFrame, kinds: Mapping[str, str], deep: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
        """``keys`` and the columns of the chosen groups as a model takes them: of the group ``deep`` the first ``depth``.

        ``kinds`` says of each column whether it is a ``category``, ``codes`` or a ``count``; counts follow ``popularity``.
        """
        count = "log_count" if self.popularity == "log1p" else "count"
        columns = feature_columns({g: list(c) for g, c in self.known.items()}, self.groups, self.depth, deep)
        return frame.select(*keys, *[feature_value(c, count if kinds[c] == "count" else kinds[c]).alias(c) for c in columns])


def check_snapshot(metadata: Mapping, policy_sha256: str, codes: set[str], types: set[str], provider: str, manual: str) -> Mapping:
    """``metadata`` of a catalogue snapshot, if it was taken under this policy, for exactly these province codes and types, from this provider."""
    wrong = {
        "policy": metadata.get("policy_config_sha256") != policy_sha256, "codes": set(metadata.get("request_config", {}).get("region_codes", [])) != codes,
        "types": set(metadata.get("supported_content_type_ids", [])) != types, "provider": (metadata.get("provider"), metadata.get("manual_version")) != (provider, manual),
    }
    if any(wrong.values()):
        raise ContractError(f"the snapshot was taken otherwise: {sorted(k for k, w in wrong.items() if w)}")
    return metadata
