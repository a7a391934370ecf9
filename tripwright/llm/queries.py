"""The ``opN_<name>`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripwright.llm import alignment, bpe, langid, packing, pii, preference, quality, sharding, simhash, substrings, topk, veccodes, vecdedup
from tripwright.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.links(table(spark, sf_dir, "embeddings"), least=0.98)


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"), window=13)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.digests(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_pii, op3_simhash, op4_quality, op5_language, op6_topk, op7_sharding, op8_vector_dedup, op9_preference, op10_packing, op11_substring_dedup, op12_token_alignment, op13_vector_codes)
}


def _vector_codes_sql(rounds: int = 4) -> str:
    """A common table for each assignment and each codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (SELECT row, p, x, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT d.row, d.p, d.x, b.e, list_sum(list_transform(range(1, len(d.x) + 1), lambda i: (d.x[i] - b.x[i]) * (d.x[i] - b.x[i]))) AS far
    FROM parts d JOIN book{k} b ON d.p = b.p) GROUP BY row, p, x)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT p, e, i.i, sum(x[i.i]) AS s, count(*) AS n FROM near{k}, unnest(range(1, len(x) + 1)) AS i(i) GROUP BY p, e, i.i),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums{k} GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    tables = ",\n".join(steps)
    return f"""
WITH usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT *, row_number() OVER (ORDER BY vec_id, q) AS row FROM usable),
parts AS (SELECT row, p.p, q[p.p * len(q) // 4 + 1:(p.p + 1) * len(q) // 4] AS x FROM rows, range(4) AS p(p)),
book0 AS (SELECT p, row - 1 AS e, x FROM parts WHERE row <= 256),
{tables},
coded AS (SELECT row, string_agg(lower(lpad(printf('%x', e), 2, '0')), '' ORDER BY p) AS code, sum(far) AS error FROM near{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS d FROM (SELECT p, e, i.i, x[i.i] AS v FROM book{rounds}, unnest(range(1, len(x) + 1)) AS i(i)))
SELECT r.vec_id, c.code, CAST(c.error AS BIGINT) AS error, CAST(sum(c.error) OVER (PARTITION BY r.label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM rows r JOIN coded c ON r.row = c.row, digest
"""


ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _vector_codes_sql(),
    "op11_substring_dedup": r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, t.i, array_to_string(words[t.i:t.i + 12], ' ') AS passage FROM split, unnest(range(1, len(words) - 11)) AS t(i)),
starts AS (SELECT passage, min(doc_id) AS first_doc FROM windows GROUP BY passage),
repeated AS (SELECT w.doc_id, w.i FROM windows w JOIN starts s ON w.passage = s.passage AND w.doc_id > s.first_doc),
gone AS (SELECT DISTINCT doc_id, i + k.k AS i FROM repeated, range(13) AS k(k)),
kept AS (SELECT s.doc_id, count(g.i) AS removed, string_agg(s.words[t.i], ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS line
    FROM split s, unnest(range(1, len(words) + 1)) AS t(i) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = t.i GROUP BY s.doc_id)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
""",
}
