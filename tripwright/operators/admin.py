"""Administrative districts of places, from codes and from the first words of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwright.functions.address import province
from tripwright.functions.text import clean, squeeze


def lookup(codebook: DataFrame) -> DataFrame:
    """code, sido_code, sido_name, sgg_name, sido_key, sgg_key of the well-formed rows of a codebook.

    ``codebook(code, sido_code, sgg_part, sido_name, sgg_name)``; a code with two
    different names is an error.
    """
    code, sido, part = (clean(F.col(c)) for c in ("code", "sido_code", "sgg_part"))
    rows = codebook.select(code.alias("code"), sido.alias("sido_code"), part.alias("sgg_part"), clean(F.col("sido_name")).alias("sido_name"), clean(F.col("sgg_name")).alias("sgg_name"))
    sound = rows.where("length(code) = 5 AND length(sido_code) = 2 AND length(sgg_part) = 3 AND code = concat(sido_code, sgg_part) AND sido_name IS NOT NULL AND sgg_name IS NOT NULL").distinct()
    if not sound.groupBy("code").count().where("count > 1").isEmpty():
        raise ValueError("a code with conflicting names")
    return sound.select("code", "sido_code", "sido_name", "sgg_name", squeeze(province(F.col("sido_name"))).alias("sido_key"), squeeze("sgg_name").alias("sgg_key"))


def _registered(value: Column) -> Column:
    """The five digits that a code of 5 digits, or of 10 that end in five zeros, stands for."""
    c = clean(value)
    return F.when((F.length(c) == 5) | ((F.length(c) == 10) & F.endswith(c, F.lit("00000"))), F.left(c, F.lit(5)))


def evidence(rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, source, code, via: every district that ``rows(id, source, code, address)`` speak for.

    ``via`` is code, address, or address_ambiguous (no code) where the first one to
    three words after the province name more than one district.
    """
    by_code = rows.select("id", "source", _registered(F.col("code")).alias("code")).join(known.select("code"), "code", "left_semi")
    words = F.filter(F.split("address", r"\s+"), lambda x: x != "")
    # Few distinct addresses stand for many rows, and each is looked up once.
    spelt = rows.where("address IS NOT NULL").select("address").distinct().withColumn("w", words).where("size(w) >= 2")
    names = spelt.select("address", squeeze(province(F.get("w", 0))).alias("sido_key"), F.explode(F.expr("sequence(1, least(3, size(w) - 1))")).alias("k"), "w")
    names = names.select("address", "sido_key", squeeze(F.array_join(F.slice("w", 2, F.col("k")), "")).alias("sgg_key"))
    found = names.join(known.select("code", "sido_key", "sgg_key"), ["sido_key", "sgg_key"]).groupBy("address").agg(F.count_distinct("code").alias("n"), F.min("code").alias("found"))
    by_address = rows.select("id", "source", "address").join(found, "address")
    return (
        by_code.select("id", "source", "code", F.lit("sgg_code").alias("via"))
        .unionByName(by_address.select("id", "source", F.when(F.col("n") == 1, F.col("found")).alias("code"), F.when(F.col("n") == 1, "address").otherwise("address_ambiguous").alias("via")))
    )


def resolve(places: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, status, code, sido_code, provenance, conflict_sources of each of ``places(id)``.

    Two sources speak, ``master`` and ``tourapi``; visits never do.  More than one
    district is a conflict, before an address that names several, before one district.
    """
    said = evidence(rows, known)
    codes = lambda s: F.collect_set(F.when(F.col("source") == s, F.col("code")))
    per = said.groupBy("id").agg(codes("master").alias("m"), codes("tourapi").alias("t"), F.bool_or(F.col("code").isNull()).alias("unclear"), F.array_sort(F.collect_set(F.concat_ws("_", "source", "via"))).alias("p"))
    every, m, t = F.array_union("m", "t"), F.size("m"), F.size("t")
    apart = (m > 0) & (t > 0) & ~F.arrays_overlap("m", "t")
    differ = F.size(every) > 1
    blamed = F.array_compact(F.array(F.when((m > 1) | (differ & (m > 0)), "master"), F.when((t > 1) | (differ & (apart | (m == 0))), "tourapi")))
    per = per.withColumn("blamed", blamed)
    status = (
        F.when(F.size("blamed") > 0, "conflict").when(F.col("unclear"), "ambiguous_address").when(F.size(every) == 0, "unavailable")
        .when((m > 0) & (t > 0), "resolved_multi_source").otherwise("resolved_single_source")
    )
    one = per.select("id", status.alias("status"), F.when(F.startswith(status, F.lit("resolved")), F.get(every, 0)).alias("code"), F.array_join("p", "|").alias("provenance"), F.array_join("blamed", "|").alias("conflict_sources"))
    out = places.join(one, "id", "left").join(known.select("code", "sido_code"), "code", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("id", F.coalesce("status", F.lit("unavailable")).alias("status"), "code", "sido_code", blank("provenance"), blank("conflict_sources"))


def compare_visits(resolved: DataFrame, visit_rows: DataFrame, known: DataFrame) -> DataFrame:
    """id, state: whether what visits say of a place agrees with its district; the district stays as it is."""
    said = evidence(visit_rows.withColumn("source", F.lit("visit")), known)
    per = said.groupBy("id").agg(F.collect_set("code").alias("v"), F.bool_or(F.col("code").isNull()).alias("unclear"))
    n = F.coalesce(F.size("v"), F.lit(0))
    state = (
        F.when(F.coalesce("unclear", F.lit(False)), "visit_address_ambiguous").when(n <= 0, "no_visit_location_evidence").when(n > 1, "visit_internal_conflict")
        .when(F.col("code").isNull(), "visit_only_unconfirmed").when(F.get("v", 0) == F.col("code"), "agrees").otherwise("conflicts_with_static")
    )
    return resolved.select("id", "code").join(per, "id", "left").select("id", state.alias("state"))


def item_district(visit_codes: Column, master_code: Column) -> tuple[Column, Column]:
    """(outcome, code) from the set of a place's visit codes and its master code."""
    v, n = F.get(visit_codes, 0), F.size(visit_codes)
    outcome = F.when((n > 1) | ((n == 1) & master_code.isNotNull() & (master_code != v)), "value_conflicts").when(n == 1, "direct").when(master_code.isNotNull(), "master_filled").otherwise("unavailable")
    return outcome, F.when(outcome == "direct", v).when(outcome == "master_filled", master_code)
