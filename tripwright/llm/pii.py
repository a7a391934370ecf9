"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Everything is a Column expression or a DataFrame operation.  A scan turns each text
into its base spans and its candidate spans (tokens and groups of digits that look like
identifiers) with the words around them.  Base spans are the seeds.  The words before
and after a span and the label of its line are lexical patterns; patterns and the values that
they stand beside form a graph.  Each round scores the patterns by the values that are known
to be of a kind, and the candidates by the patterns that pass; candidates found in one
round are seeds of the next, so that they can induce patterns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import join_by_key, materialize

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

# The contract's patterns, with possessive repeats and a guard that lets a match start
# only where its first run of characters starts or the match before it ended.  Neither
# changes a match; both keep the matcher linear, and off the stack, in very long runs.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: groups of digits between spaces, marks and brackets, or else tokens of 6 or more characters with a digit or an at sign.
#: Base spans are hidden behind \\x01, which no candidate touches.
_GROUPS = r"(?<![A-Za-z0-9._@+\x01-])\+?\(?[0-9]++\)?(?:[\x20./-]{1,2}\(?[0-9]++\)?)++(?![A-Za-z0-9@_\x01])"
_TOKEN = r"(?<![A-Za-z0-9._@+\x01-])(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9+][A-Za-z0-9._@+-]{4,}(?<=[A-Za-z0-9])(?![A-Za-z0-9\x01])"
_CANDIDATE = f"{_GROUPS}|{_TOKEN}"
#: Digits that a group of digits has to be a candidate.
_GROUP_DIGITS = (6, 24)
_WORD, _GAP = r"\p{L}[\p{L}\p{M}'_-]{0,31}", r"[^\p{L}\p{N}]{1,8}"
#: Characters of context that a span carries on each side, within the gap to the next span of its own sort.
_REACH = 48
#: Columns that a scan adds; the prefix keeps them apart from a table's own.
BASE, CANDIDATES = "__tw_base", "__tw_candidates"
#: The rank of a candidate; kinds have 0 to 3.
CANDIDATE = 9
_SPAN = "array<struct<start:int,end:int,rank:int,value:string,before:string,after:string>>"
#: Spans that one fold appends to an array before it is closed; appending to one long array would copy it each time.
_FOLD = 256


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _located(text: str, pattern: str, rank: int, gate: str) -> Column:
    """All matches with their places in code points: gaps from split, matches from extract_all."""
    place = "b.at + length(x.g[i])"
    before = f"concat(CASE WHEN i = 0 AND length(x.g[0]) <= {_REACH} THEN '\n' ELSE '' END, right(x.g[i], {_REACH}))"
    span = f"struct({place} AS start, {place} + length(x.m[i]) AS end, {rank} AS rank, x.m[i] AS value, {before} AS before, left(x.g[i + 1], {_REACH}) AS after)"
    part = f"""aggregate(sequence(c * {_FOLD}, least(size(x.m) - 1, c * {_FOLD} + {_FOLD - 1})), struct(a.at AS at, CAST(array() AS {_SPAN}) AS part),
        (b, i) -> struct({place} + length(x.m[i]) AS at, concat(b.part, array({span})) AS part), b -> struct(b.at AS at, concat(a.out, array(b.part)) AS out))"""
    whole = f"aggregate(sequence(0, (size(x.m) - 1) DIV {_FOLD}), struct(0 AS at, CAST(array() AS array<{_SPAN}>) AS out), (a, c) -> {part}, a -> flatten(a.out))"
    return F.expr(f"""CASE WHEN {gate} THEN transform(array(struct(regexp_extract_all({text}, {_q(pattern)}, 0) AS m, split({text}, {_q(pattern)}, -1) AS g)), x ->
        CASE WHEN size(x.m) = 0 THEN CAST(array() AS {_SPAN}) ELSE {whole} END)[0] ELSE CAST(array() AS {_SPAN}) END""")


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_PASSES = (
    "true",
    "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
    f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})",
    f"length({_DIGITS}) BETWEEN 10 AND 15",
)


def _replaced(text: str, spans: str, by: str) -> Column:
    """``text`` with its ``spans``, sorted by start, replaced: ``by`` is written of the span x and of b.at, where the text before it ended.

    A span that lies within the ones before it goes; of one that overlaps them the
    rest is replaced.  A fold cuts its own piece of the text first, since a place in a
    long string is found by counting from its start.
    """
    gap = "substring(b.w, b.at - b.base + 1, greatest(x.start - b.at, 0))"
    keep = f"CASE WHEN x.end <= b.at THEN b ELSE struct(x.end AS at, concat(b.part, array(concat({gap}, {by}))) AS part, b.w AS w, b.base AS base) END"
    own = f"slice({spans}, c * {_FOLD} + 1, {_FOLD})"
    first = f"struct(a.at AS at, CAST(array() AS array<string>) AS part, substring({text}, a.at + 1, greatest(array_max(transform({own}, y -> y.end)) - a.at, 0)) AS w, a.at AS base)"
    part = f"aggregate({own}, {first}, (b, x) -> {keep}, b -> struct(b.at AS at, concat(a.out, array(array_join(b.part, ''))) AS out))"
    return F.expr(f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate(sequence(0, (size({spans}) - 1) DIV {_FOLD}), struct(0 AS at, CAST(array() AS array<string>) AS out),
        (a, c) -> {part}, a -> concat(array_join(a.out, ''), substring({text}, a.at + 1))) END""")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add BASE and CANDIDATES, arrays of spans, to each row.  A null text has none."""
    kept = [f"`{c}`" for c in docs.columns]
    out = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__tw_t"))
    out = out.select(*kept, "__tw_t", F.expr("contains(__tw_t, '@')").alias("__tw_at"), F.expr("__tw_t RLIKE '[0-9]'").alias("__tw_digit"))
    gates = ("__tw_at", "__tw_digit AND contains(__tw_t, '.')", "__tw_digit", "__tw_digit AND contains(__tw_t, '+')")
    found = [_located("__tw_t", p, k, gate).alias(f"__tw_s{k}") for k, (p, gate) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE), gates))]
    out = out.select(*kept, "__tw_t", "__tw_at", "__tw_digit", *found)
    passed = ", ".join(f"filter(__tw_s{k}, x -> {test})" for k, test in enumerate(_PASSES))
    out = out.select(*kept, "__tw_t", "__tw_at", "__tw_digit", F.expr(f"array_sort(concat({passed}), (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE a.rank - b.rank END)").alias(BASE))
    out = out.withColumn("__tw_t", _replaced("__tw_t", BASE, "repeat('\x01', x.end - greatest(x.start, b.at))"))
    return out.select(*kept, BASE, F.filter(_located("__tw_t", _CANDIDATE, CANDIDATE, "__tw_digit OR __tw_at"), _is_candidate).alias(CANDIDATES))


def _is_candidate(span: Column) -> Column:
    """Tokens are; of the groups of digits those with _GROUP_DIGITS digits."""
    digits = F.length(F.regexp_replace(span["value"], "[^0-9]", ""))
    return span["value"].rlike("[A-Za-z@]") | digits.between(*_GROUP_DIGITS)


def _patterns(before: str, after: str) -> Column:
    """The lexical patterns of a span: the word before it, two words, the word after it, one on each side, the label of its line."""
    one = F.regexp_extract(before, f"({_WORD}{_GAP})$", 1)
    two = F.regexp_extract(before, f"({_WORD}{_GAP}{_WORD}{_GAP})$", 1)
    next_ = F.regexp_extract(after, f"^({_GAP}{_WORD})", 1)
    label = F.regexp_extract(before, r"\n[\x20\t]*+(\p{L}[^\n:=]{0,30}[:=][\x20\t\x22']*)$", 1)
    told = lambda kind, *parts: F.when(F.forall(F.array(*parts), lambda x: x != ""), F.concat(F.lit(f"{kind} "), F.concat_ws("_", *parts)))
    every = F.array(told("1", one), told("2", two), told("after", next_), told("around", one, next_), told("line", label))
    return F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))


def occurrences(scanned: DataFrame, key: str) -> DataFrame:
    """One row for each distinct (text, span, pattern): seeds have rank 0 to 3, candidates CANDIDATE."""
    spans = scanned.where(F.size(BASE) + F.size(CANDIDATES) > 0).select(key, F.explode(F.concat(BASE, CANDIDATES)).alias("s"))
    return spans.select(key, "s.start", "s.end", "s.rank", "s.value", F.explode(_patterns("s.before", "s.after")).alias("pattern")).distinct()


def _fits(value: str, kind: str) -> Column:
    """What a candidate must look like: an address of letters, or numbers without any."""
    return F.col(value).rlike("[A-Za-z]") == (F.col(kind) == 0)


def bootstrap(found: DataFrame, rounds: int = 3, prior: float = 2.0, doubt: float = 0.25, least_score: float = 0.7, least_seeds: int = 3) -> DataFrame:
    """Score the pattern-instance graph; ``(pattern, kind, confidence)`` of the patterns that pass.

    Each round, a pattern's confidence for a kind is the sum of its distinct values'
    scores over the number of those of a known kind, plus ``doubt`` for each of
    the others, plus ``prior``; it passes for its best kind with ``least_score`` and ``least_seeds`` values that score as much.  A seed scores 1 for
    its kind.  A candidate scores the noisy-or of the patterns that passed for a kind that it
    fits, so that it counts as a seed from the next round on.
    """
    graph = materialize(found.groupBy("pattern", "value").agg(F.min("rank").alias("rank")))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = graph.where(F.col("rank") < CANDIDATE).select("pattern", "value", F.col("rank").alias("kind"), F.lit(1.0).alias("p"))
    known = seeds
    for turn in range(rounds):
        sums = known.groupBy("pattern", "kind").agg(F.sum("p").alias("t"), F.count_if(F.col("p") >= least_score).alias("seeds"), F.count("*").alias("m"))
        best = sums.groupBy("pattern").agg(F.max(F.struct("t", -F.col("kind"), "seeds", "kind")).alias("b"), F.sum("m").alias("known")).select("pattern", "known", "b.t", "b.seeds", "b.kind")
        unknown = F.greatest(F.col("n") - F.col("known"), F.lit(0))
        passed = best.where(F.col("seeds") >= least_seeds).join(sizes, "pattern").withColumn("confidence", F.least(F.lit(0.999), F.col("t") / (F.col("known") + doubt * unknown + prior)))
        passed = materialize(passed.where(F.col("confidence") >= least_score).select("pattern", "kind", "confidence"))
        if turn == rounds - 1:
            break
        behind = graph.where(F.col("rank") == CANDIDATE).join(passed, "pattern").where(_fits("value", "kind"))
        heard = behind.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("p"))
        known = seeds.unionByName(graph.where(F.col("rank") == CANDIDATE).select("pattern", "value").join(heard, "value"))
    return passed


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__tw_key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))


def _discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(__tw_key, more)``: the spans that each text gains, of the kind of their surest pattern.  Texts are known by digest, so copies gain the same."""
    hits = found.where(F.col("rank") == CANDIDATE).join(patterns, "pattern").where(_fits("value", "kind"))
    best = hits.groupBy("__tw_key", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"), "kind")).alias("b"))
    return best.groupBy("__tw_key").agg(F.collect_list(F.struct("start", "end", F.col("b.kind").alias("rank"))).alias("__tw_more"))


def _with_discovered(scanned: DataFrame) -> DataFrame:
    """``scanned``, which is materialized, with the spans that its texts gain in ``__tw_more``; texts without candidates meet nothing."""
    found = materialize(occurrences(scanned, "__tw_key"))
    more = _discovered(found, bootstrap(found))
    open_ = scanned.where(F.size(CANDIDATES) > 0)
    sizes = open_.groupBy("__tw_key").agg(F.count("*").alias("__tw_n"))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,rank:int>>)")
    joined = join_by_key(open_, materialize(more.join(sizes, "__tw_key")), "__tw_key", "__tw_n", "left")
    return joined.withColumn("__tw_more", F.coalesce("__tw_more", none)).unionByName(scanned.where(F.size(CANDIDATES) == 0).withColumn("__tw_more", none))


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.rank + 1), ':', x.start, ':', x.end)), ',')"


def find(docs: DataFrame) -> DataFrame:
    """Personal data in each whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    One row for each row of ``docs``; a null or empty text has no spans.  The counts
    and the digest are of the base spans, which may overlap across kinds; ``spans``
    also lists the discovered ones, ``n_found`` in number, which overlap no base span.
    """
    scanned = materialize(scan(_keyed(docs.select("doc_id", "text"), "text").select("doc_id", "text", "__tw_key")).drop("text"))
    out = _with_discovered(scanned).select("doc_id", F.expr(f"transform({BASE}, x -> struct(x.start, x.end, x.rank))").alias("base"), F.col("__tw_more").alias("more"))
    order = "(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE a.rank - b.rank END"
    counts = [F.expr(f"CAST(size(filter(base, x -> x.rank = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = f"array_sort(concat(base, more), {order})"
    return out.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed(every)).alias("spans"), F.size("more").cast("long").alias("n_found"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind's label.

    Of overlapping spans the one that starts first, then the longer, is replaced, and
    the rest of the others goes with it.  A null text stays null.
    """
    columns = docs.columns
    out = _with_discovered(materialize(scan(_keyed(docs, text), text)))
    labels = "array(" + ", ".join(f"'{v}'" for v in LABELS.values()) + ")"
    order = "(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start WHEN a.end <> b.end THEN b.end - a.end ELSE a.rank - b.rank END"
    out = out.withColumn("__tw_all", F.expr(f"array_sort(concat(transform({BASE}, x -> struct(x.start, x.end, x.rank)), __tw_more), {order})"))
    cleared = _replaced(f"`{text}`", "__tw_all", f"CASE WHEN x.start < b.at THEN '' ELSE element_at({labels}, x.rank + 1) END")
    return out.withColumn(text, cleared).select(*[f"`{c}`" for c in columns])
