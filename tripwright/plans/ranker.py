"""Queries of the rank model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.operators import rankmodel
from tripwright.operators.tables import written
from tripwright.plans.queries import M
from tripwright.plans.registry import query
from tripwright.plans.training import FRAME, _frame
from tripwright.sources import mapping

FEATURES = rankmodel.Features(numbers=("popularity", "p_size"), categories=("p_brand",), crosses=(("month", "p_type"),))
ROUNDS, RATE, L2, TOP = 2, 0.5, 0.001, 10


def _rounds(objective: str) -> str:
    """Common tables of each round's scores, pulls and weights for one objective."""
    o, out = objective, [f"w0_{objective} AS MATERIALIZED (SELECT DISTINCT feature, value, 0.0::DOUBLE AS w FROM x)"]
    for k in range(ROUNDS + 1):
        out.append(f"""s{k}_{o} AS MATERIALIZED (SELECT *, CASE WHEN rank <= {TOP} THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END AS d FROM
    (SELECT *, row_number() OVER (PARTITION BY region, query ORDER BY round(s, 12) DESC, poi) AS rank FROM
      (SELECT x.region, x.query, x.poi, any_value(label) AS label, any_value(m) AS m, any_value(o) AS o, any_value(idcg) AS idcg, sum(x * w) AS s FROM x JOIN groups g ON g.region = x.region AND g.query = x.query
        JOIN w{k}_{o} w ON w.feature = x.feature AND w.value IS NOT DISTINCT FROM x.value GROUP BY x.region, x.query, x.poi)))""")
        if o == "listwise":
            out.append(f"""t{k}_{o} AS (SELECT region, query, max(s) AS top, sum(exp(s)) AS total FROM s{k}_{o} GROUP BY ALL),
  p{k}_{o} AS MATERIALIZED (SELECT s.region, s.query, poi, label / m - exp(s) / total AS pull, CASE WHEN label = 1 THEN -(s - ln(total)) / m ELSE 0 END AS loss FROM s{k}_{o} s JOIN t{k}_{o} t ON s.region = t.region AND s.query = t.query)""")
        else:
            weight = "1 / (a.m * a.o)" if o == "pairwise" else "abs(a.d - b.d) / a.idcg"
            out.append(f"""q{k}_{o} AS (SELECT region, query, a, b, weight / (1 + exp(margin)) AS pull, weight * ln(1 + exp(-margin)) AS loss FROM
    (SELECT a.region, a.query, a.poi AS a, b.poi AS b, {weight} AS weight, a.s - b.s AS margin FROM s{k}_{o} a JOIN s{k}_{o} b ON a.region = b.region AND a.query = b.query AND a.label = 1 AND b.label = 0)),
  p{k}_{o} AS MATERIALIZED (SELECT region, query, a AS poi, pull, loss FROM q{k}_{o} UNION ALL SELECT region, query, b, -pull, 0 FROM q{k}_{o})""")
        out.append(f"""h{k}_{o} AS (SELECT {k} AS round, (SELECT sum(loss) FROM p{k}_{o}) / n AS loss, (SELECT sum(d / idcg) FROM s{k}_{o} WHERE label = 1) / n AS ndcg FROM many)""")
        if k < ROUNDS:
            out.append(f"""w{k + 1}_{o} AS MATERIALIZED (SELECT w.feature, w.value, w + {RATE} * (coalesce(g, 0) / n - {L2} * w) AS w FROM many, w{k}_{o} w LEFT JOIN
    (SELECT feature, value, sum(x * pull) AS g FROM x JOIN (SELECT region, query, poi, sum(pull) AS pull FROM p{k}_{o} GROUP BY ALL) p ON p.region = x.region AND p.query = x.query AND p.poi = x.poi GROUP BY ALL) g ON g.feature = w.feature AND g.value IS NOT DISTINCT FROM w.value)""")
    return ",\n  ".join(out)


def _told(objective: str) -> str:
    rounds = " UNION ALL ".join(f"SELECT '{objective}' AS objective, CAST(round AS INT) AS round, '{m}' AS measure, NULL AS value, round({m}, 6) AS x FROM h{k}_{objective}" for k in range(ROUNDS + 1) for m in ("loss", "ndcg"))
    return f"{rounds} UNION ALL SELECT '{objective}', {ROUNDS}, feature, value, round(w, 6) FROM w{ROUNDS}_{objective} UNION ALL SELECT '{objective}', {ROUNDS}, unnest(['p_brand', 'month×p_type']), NULL, 0"


@query(f"""{M}, {FRAME}, base AS (SELECT f.*, CAST(p_size AS DOUBLE) AS p_size, p_brand, p_type FROM frame f JOIN part ON f.poi = CAST(p_partkey AS VARCHAR)),
  scale AS (SELECT avg(popularity) AS mp, stddev_pop(popularity) AS sp, avg(p_size) AS ms, stddev_pop(p_size) AS ss FROM base),
  x AS MATERIALIZED (SELECT region, query, poi, label, 'popularity' AS feature, NULL::VARCHAR AS value, (popularity - mp) / sp AS x FROM base, scale UNION ALL SELECT region, query, poi, label, 'p_size', NULL, (p_size - ms) / ss FROM base, scale
    UNION ALL SELECT region, query, poi, label, 'p_brand', p_brand, 1 FROM base UNION ALL SELECT region, query, poi, label, 'month×p_type', month || chr(31) || p_type, 1 FROM base),
  groups AS MATERIALIZED (SELECT region, query, sum(label)::DOUBLE AS m, count(*) - sum(label)::DOUBLE AS o, (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, CAST(least(sum(label), {TOP}) AS BIGINT) + 1) t(i)) AS idcg FROM base GROUP BY ALL),
  many AS (SELECT count(*) AS n FROM groups), {", ".join(_rounds(o) for o in rankmodel.OBJECTIVES)}
  {" UNION ALL ".join(_told(o) for o in rankmodel.OBJECTIVES)}""")
def rank_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What each round of each objective measures, and the weights after the last."""
    parts = mapping.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("poi"), "p_size", "p_brand", "p_type")
    frame = written(_frame(spark, d).join(parts, "poi"))
    models = {o: rankmodel.fit_ranker(frame, FEATURES, o, ROUNDS, RATE, L2, TOP) for o in rankmodel.OBJECTIVES}
    told = rankmodel.history_frame(spark, models).withColumn("measure", F.explode(F.array(F.lit("loss"), F.lit("ndcg"))))
    told = told.select("name", "round", "measure", F.lit(None).cast("string").alias("value"), F.when(F.col("measure") == "loss", F.col("loss")).otherwise(F.col("ndcg")).alias("x"))
    weights = rankmodel.weights_frame(spark, models).select("name", F.lit(ROUNDS).alias("round"), F.col("feature").alias("measure"), "value", F.col("weight").alias("x"))
    return told.unionByName(weights).select(F.col("name").alias("objective"), "round", "measure", "value", F.round("x", 6).alias("x"))
