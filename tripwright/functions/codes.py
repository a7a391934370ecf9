"""Code domains, count parsing and administrative codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwright.functions.text import clean

# The domains of the coded fields.
STYLE = [str(i) for i in range(1, 8)]
MOTIVE = [str(i) for i in range(1, 11)]
RELATION = [str(i) for i in range(1, 12)]
FEEDBACK = [str(i) for i in range(1, 6)]
TOURISM_CORE = ["1", "2", "3", "5", "6", "7", "8", "12", "13"]
NON_TOURISM = ["4", "9", "10", "11", "21", "22", "23", "24"]
VISIT_KIND = TOURISM_CORE + NON_TOURISM

# How province and district codes were renumbered.
PROVINCES = {"42": "51", "45": "52", "29": "12", "46": "12", "36": "36110"}
GWANGJU = {"29110": "210", "29140": "240", "29155": "270", "29170": "300", "29200": "330"}
JEONNAM = {
    "46110": "110", "46130": "130", "46150": "150", "46170": "170", "46230": "190", "46710": "710", "46720": "720", "46730": "730",
    "46770": "740", "46780": "750", "46790": "760", "46800": "770", "46810": "780", "46820": "790", "46830": "800", "46840": "810",
    "46860": "820", "46870": "830", "46880": "840", "46890": "850", "46900": "860", "46910": "870",
}
#: Cities whose districts share the first four digits.
DISTRICT_CITIES = ["4111", "4113", "4117", "4127", "4128", "4146", "4311", "4413", "4511", "5211", "4711", "4812"]


def in_domain(c: Column, domain: Iterable[str]) -> Column:
    """The trimmed code, or null outside its domain."""
    return F.when(clean(c).isin(*domain), clean(c))


def parse_count(c: Column) -> Column:
    """A whole, non-negative number, written as an integer or an integral decimal; else null."""
    text = clean(c)
    x = text.try_cast("double")
    whole = F.when((x >= 0) & (x == F.floor(x)), x.try_cast("long"))
    return F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("long")).otherwise(whole)


def parse_coordinate(c: Column) -> Column:
    """A number that may stand in quotation marks; anything else is null."""
    return F.btrim(F.btrim(c), F.lit('"')).try_cast("double")


def _lookup(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def sgg_compatible(code: Column, regn: Column, signgu: Column) -> Column:
    """Whether a source district code and a catalogue (province, district) pair can be the same place."""
    code, regn, signgu = (F.coalesce(F.btrim(x), F.lit("")) for x in (code, regn, signgu))
    five, one, two = F.substr(code, F.lit(1), F.lit(5)), F.substr(code, F.lit(1), F.lit(2)), F.substr(code, F.lit(3), F.lit(3))
    merged = F.coalesce(_lookup(GWANGJU | JEONNAM, five), F.lit(""))
    province = F.coalesce(_lookup(PROVINCES, one), one)
    same_city = (F.length(signgu) == 3) & (F.left(two, F.lit(2)) == F.left(signgu, F.lit(2))) & (F.concat(one, F.left(two, F.lit(2))).isin(*DISTRICT_CITIES) | F.concat(regn, F.left(signgu, F.lit(2))).isin(*DISTRICT_CITIES))
    zero = lambda x: F.right(x, F.lit(1)) == "0"
    ward = lambda x: F.right(x, F.lit(1)).between("1", "9")
    parent = (zero(two) & ward(signgu)) | (zero(signgu) & ward(two))
    long_code = (
        F.when(one == "36", regn.isin("36110", "36") & signgu.isin("36110", "110", ""))
        .when(merged != "", (regn == "12") & (signgu == merged))
        .otherwise((province == regn) & ((two == signgu) | (same_city & parent)))
    )
    short_code = (
        F.when(one == "36", regn.isin("36110", "36"))
        .when(one == "29", (regn == "12") & signgu.isin(*GWANGJU.values()))
        .when(one == "46", (regn == "12") & signgu.isin(*JEONNAM.values()))
        .otherwise(province == regn)
    )
    return F.when(F.length(code) >= 5, long_code).when(F.length(code) == 2, short_code).otherwise(F.lit(False))


def sgg_keys(code: Column) -> Column:
    """Keys of a source district code, of which every pair that ``sgg_compatible`` accepts has one among its ``pair_keys``."""
    code = F.coalesce(F.btrim(code), F.lit(""))
    one, two = F.substr(code, F.lit(1), F.lit(2)), F.substr(code, F.lit(3), F.lit(3))
    merged, province = _lookup(GWANGJU | JEONNAM, F.left(code, F.lit(5))), F.coalesce(_lookup(PROVINCES, one), one)
    key, city = (lambda a, b: F.concat(a, F.lit("/"), b)), F.left(two, F.lit(2))
    cities = F.concat(one, city).isin(*DISTRICT_CITIES) | F.concat(province, city).isin(*DISTRICT_CITIES)
    sejong = F.array(F.lit("36110/"), F.lit("36/"))
    whole = F.when(one == "36", sejong).when(merged.isNotNull(), F.array(key(F.lit("12"), merged))).otherwise(F.array_compact(F.array(key(province, two), F.when(cities, F.concat(key(province, city), F.lit("*"))))))
    short = F.when(one == "36", sejong).otherwise(F.array(key(province, F.lit(""))))
    return F.when(F.length(code) >= 5, whole).when(F.length(code) == 2, short).otherwise(F.array().cast("array<string>"))


def pair_keys(regn: Column, signgu: Column) -> Column:
    """Keys of a catalogue (province, district) pair: itself, its province, and its city."""
    regn, signgu = (F.concat(F.coalesce(F.btrim(x), F.lit("")), F.lit(end)) for x, end in ((regn, "/"), (signgu, "")))
    return F.array_distinct(F.array(F.concat(regn, signgu), regn, F.concat(regn, F.left(signgu, F.lit(2)), F.lit("*"))))


def catalogue_pair(code: Column, known: Column | None = None) -> Column:
    """The catalogue's (province, district) of a source district code by its first five digits, null where it does not start with five.

    ``known`` is what a loaded crosswalk says of the code, if it says anything; the renumbering answers otherwise.
    """
    text = clean(code)
    five, one, two = F.left(text, F.lit(5)), F.left(text, F.lit(2)), F.substr(text, F.lit(3), F.lit(3))
    pair = lambda regn, signgu: F.struct(regn.alias("regn"), signgu.alias("signgu"))
    merged = _lookup(GWANGJU | JEONNAM, five)
    whole = F.when(one == "36", pair(F.lit("36110"), F.lit("36110"))).when(merged.isNotNull(), pair(F.lit("12"), merged)).otherwise(pair(F.coalesce(_lookup(PROVINCES, one), one), two))
    return F.when(five.rlike("^[0-9]{5}$"), whole if known is None else F.coalesce(known, whole))


def anomaly(value: Column, allowed: Iterable[str], listed: Iterable[str] = (), special: Iterable[str] = (), elsewhere: Iterable[str] = ()) -> Column:
    """Why a code is outside its domain.

    ``allowed`` is the documented domain; ``listed`` the reference table's codes of the
    field's group, of which ``special`` are residual categories; ``elsewhere`` codes of
    other groups.  They are codebooks, and small.
    """
    allowed, listed, special, elsewhere = map(list, (allowed, listed, special, elsewhere))
    parts = F.split(value, r"[,;|/]", -1)
    every = lambda known: F.forall(parts, lambda x: x.isin(*known) if known else F.lit(False))
    blank = r"\s"
    delimited = (
        F.when(F.exists(parts, lambda x: x == ""), "delimited_representation_with_empty_component").when(F.exists(parts, lambda x: x.rlike(blank)), "delimited_representation_with_whitespace")
        .when(every(allowed) & every(listed), "multiple_exact_hwp_and_reference_codes_delimited").when(every(allowed), "multiple_exact_hwp_domain_codes_delimited")
        .when(every(listed), "multiple_exact_reference_codes_delimited").otherwise("delimited_components_not_fully_mapped")
    )
    one = lambda known: value.isin(*known) if known else F.lit(False)
    whole = (
        F.when(value.rlike(blank), "whitespace_or_format_representation").when(one(allowed), "in_domain").when(one(special), "reference_table_special_category")
        .when(one(listed), "reference_table_entry_outside_manual_range").when(one(elsewhere), "reference_entry_for_other_code_group")
        .when(value.rlike("^[0-9]+$"), "undocumented_numeric_code").otherwise("undocumented_non_numeric_representation")
    )
    return F.when(value.rlike(r"[,;|/]"), delimited).otherwise(whole)
