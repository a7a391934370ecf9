"""Preference formatting: one prompt and two masked completions for each pair.

Conversations become arrays of turns in Spark; the longest common prefix, the
rendering and the masks are higher-order functions over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import gapless_index, hash_buckets, materialize

_TURNS = "array<struct<role:string,text:string>>"
FOLD = 256


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ``turns`` in order: by turn, then role, then text; null turns first.

    A turn that stands twice (same turn, role and text) counts once, a null role or
    text as empty; rows without a conv_id have no conversation.
    """
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text")))
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.expr("transform(t, x -> struct(x.role, x.text))").alias("turns"))


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat('<|', x.role, '|>\\n', x.text, '\\n')), '')"


def _mask(turns: str) -> str:
    """start:end, in code points of the completion, of what is trained on: assistants' texts.

    Folded by FOLD turns, so that no long array is appended to.
    """
    own = f"CASE WHEN x.role = 'assistant' THEN array(concat(b.at + length(x.role) + 5, ':', b.at + length(x.role) + length(x.text) + 5)) ELSE CAST(array() AS array<string>) END"
    part = f"aggregate(slice({turns}, c * {FOLD} + 1, {FOLD}), struct(a.at AS at, CAST(array() AS array<string>) AS part), (b, x) -> struct(b.at + length(x.role) + length(x.text) + 6 AS at, concat(b.part, {own}) AS part), b -> struct(b.at AS at, concat(a.out, array(b.part)) AS out))"
    spans = f"aggregate(sequence(0, (greatest(size({turns}), 1) - 1) DIV {FOLD}), struct(0 AS at, CAST(array() AS array<array<string>>) AS out), (a, c) -> {part}, a -> flatten(a.out))"
    return f"array_join({spans}, ',')"


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Format ``pairs(chosen, rejected)`` of turn arrays; other columns stay.

    Adds prefix_turns, prompt, chosen_completion, rejected_completion, chosen_mask and
    rejected_mask.  The prompt is the longest common prefix of turns, equal in role
    and text, and rendered once; a mask lists the spans of the completion that an
    assistant wrote.  A null side has no turns, an empty completion and mask.
    """
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    out = pairs.select(*kept, *[F.coalesce(c, F.expr(f"CAST(array() AS {_TURNS})")).alias(f"_{c[0]}") for c in ("chosen", "rejected")])
    same = "coalesce(array_position(zip_with(_c, _r, (a, b) -> coalesce(a = b, false)), false) - 1, CAST(0 AS BIGINT))"
    out = out.withColumn("prefix_turns", F.expr(f"CASE WHEN {same} >= 0 THEN {same} ELSE CAST(least(size(_c), size(_r)) AS BIGINT) END"))
    rest = "slice({0}, CAST(prefix_turns AS INT) + 1, size({0}))"
    out = out.select(*kept, "prefix_turns", F.expr("slice(_c, 1, CAST(prefix_turns AS INT))").alias("_p"), *[F.expr(f"CASE WHEN size({c}) > prefix_turns THEN {rest.format(c)} ELSE CAST(array() AS {_TURNS}) END").alias(c) for c in ("_c", "_r")])
    return out.select(
        *kept, "prefix_turns", F.expr(_render("_p")).alias("prompt"),
        F.expr(_render("_c")).alias("chosen_completion"), F.expr(_render("_r")).alias("rejected_completion"),
        F.expr(_mask("_c")).alias("chosen_mask"), F.expr(_mask("_r")).alias("rejected_mask"),
    )


#: Places of the assistant's turns in ``turns``.
_SPOKEN = "filter(transform(turns, (x, i) -> CASE WHEN x.role = 'assistant' THEN i ELSE -1 END), i -> i >= 0)"


def pair_up(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, kind, chosen, rejected: every conversation in a pair.

    Conversations with the same first turn are paired two by two; the one in which
    assistants wrote more, or else of the smaller conv_id, is chosen (kind
    ``shared``).  Each other one is chosen against itself with its last answer put back to
    the answer before it (``swapped``); with one answer only, to the last answer of
    the next conversation that is like it in the roles of its turns (``borrowed``); and
    if none is, against what precedes the answer (``single``, an empty rejected
    completion, as for conversations without any answer).  Partners meet by rank, so
    no task holds all of one first turn or of one sequence of roles.
    """
    talks = conversations(turns).withColumn("first", F.unhex(F.sha2(F.expr("to_json(turns[0])"), 256)))
    talks = materialize(talks.withColumn("said", F.expr("aggregate(turns, CAST(0 AS BIGINT), (a, x) -> a + CASE WHEN x.role = 'assistant' THEN length(x.text) ELSE 0 END)")))
    ranked = gapless_index(talks.select("conv_id", "first"), ["first"], [F.col("conv_id")], hash_buckets(talks, "conv_id"), "nth")
    ranked = ranked.select("conv_id", F.floor(F.col("nth") / 2).alias("pair"), F.pmod("nth", F.lit(2)).alias("side"))
    talks = talks.join(ranked, "conv_id")
    a, b = (talks.where(f"side = {k}").select("first", "pair", F.struct("conv_id", "turns", "said").alias(f"s{k}")) for k in (0, 1))
    both = materialize(a.join(b, ["first", "pair"], "left"))
    swap = F.expr("s1.said > s0.said OR (s1.said = s0.said AND s1.conv_id < s0.conv_id)")
    two = both.where("s1 IS NOT NULL").select(F.when(swap, F.col("s1")).otherwise(F.col("s0")).alias("c"), F.when(swap, F.col("s0")).otherwise(F.col("s1")).alias("r"))
    shared = two.select(F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.lit("shared").alias("kind"), F.col("c.turns").alias("chosen"), F.col("r.turns").alias("rejected"))

    alone = both.where("s1 IS NULL").select("s0.conv_id", "s0.turns").withColumn("at", F.expr(_SPOKEN))
    own = alone.where("size(at) <> 1")
    before = "slice(turns, 1, CASE WHEN size(at) = 0 THEN size(turns) ELSE element_at(at, -1) END)"
    put_back = "CASE WHEN size(at) > 1 THEN transform(turns, (x, i) -> CASE WHEN i = element_at(at, -1) THEN turns[element_at(at, -2)] ELSE x END) ELSE " + before + " END"
    swapped = own.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id"), F.expr("CASE WHEN size(at) > 1 THEN 'swapped' ELSE 'single' END").alias("kind"), F.col("turns").alias("chosen"), F.expr(put_back).alias("rejected"))

    few = materialize(alone.where("size(at) = 1").withColumn("roles", F.md5(F.expr("to_json(transform(turns, x -> x.role))"))))
    few = gapless_index(few, ["roles"], [F.col("conv_id")], hash_buckets(few, "conv_id"), "nth")
    sizes = few.groupBy("roles").agg(F.count("*").alias("many"))
    next_ = few.select("roles", F.col("nth").alias("next"), F.col("conv_id").alias("rejected_id"), F.expr("turns[element_at(at, -1)]").alias("answer"))
    met = few.join(sizes, "roles").withColumn("next", F.pmod(F.col("nth") + 1, "many")).join(next_, ["roles", "next"])
    lone = F.col("many") == 1
    borrowed = met.select(
        F.col("conv_id").alias("chosen_id"), F.when(~lone, F.col("rejected_id")).alias("rejected_id"), F.when(lone, "single").otherwise("borrowed").alias("kind"), F.col("turns").alias("chosen"),
        F.when(lone, F.expr(before)).otherwise(F.expr("transform(turns, (x, i) -> CASE WHEN i = element_at(at, -1) THEN answer ELSE x END)")).alias("rejected"),
    )
    return shared.unionByName(swapped).unionByName(borrowed)


def format_preferences(turns: DataFrame) -> DataFrame:
    """The formatted pairs of a table of turns: one row a pair, each conversation chosen or rejected in one.

    Only conv_id, turn, role and text are read, whatever other columns there are.  A
    conversation that only lent an answer is chosen in a pair of its own.
    """
    return format_pairs(pair_up(turns))
