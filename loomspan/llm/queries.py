"""Queries over the operators of this subpackage, one for each, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import lang_id, pii, toxicity
from loomspan.llm.bpe import encode
from loomspan.llm.decontaminate import find_leaks
from loomspan.llm.fingerprints import version_likeness
from loomspan.llm.jaccard_join import jaccard_components
from loomspan.llm.lm import lm_scores
from loomspan.llm.secrets import RULES, find_secrets
from loomspan.llm.shared import documents
from loomspan.llm.token_counts import token_counts


def fold(mod: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo mod; 1 for a null id, which is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod, F.lit(1))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_personal_data(docs, pii.fit(docs)).drop("base", "added")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lm_scores(docs, docs.filter(fold(10) != 0))
    return scored.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_likeness(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.severity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    joined = lambda kinds: F.expr(f"array_join(transform(filter(found, x -> x.kind in ({kinds})), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    base, every = (", ".join(f"'{r.kind}'" for r in RULES if r.base or more) for more in (False, True))
    count = lambda kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in RULES if r.base], F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))


def secrets_sql() -> str:
    """op6 in DuckDB: places from the lengths of matches and of the pieces between them."""
    parts = []
    for n, r in enumerate(RULES):
        regex = r.regex.replace("'", "''").replace("(?i:", "(?i)(?:")
        ok = f"length(regexp_extract(m[i], '{regex}', {r.group})) >= {r.least}" if r.least else "true"
        parts.append(f"""SELECT row, {n} AS ord, '{r.kind}' AS kind, i, ok, a AS start, a + length(m[i]) AS stop FROM (
            SELECT row, m, i, {ok} AS ok, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM (
            SELECT row, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT row, regexp_extract_all(text, '{regex}') AS m, string_split_regex(text, '{regex}') AS g FROM d)))""")
    every = " UNION ALL ".join(parts)
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    joined = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        s AS (SELECT * FROM ({every}) WHERE ok)
        SELECT doc_id, {counts}, sha256({joined.format(f" FILTER (kind IN ({base}))")}) AS base_sha256, {joined.format("")} AS spans
        FROM d LEFT JOIN s USING (row) GROUP BY row, doc_id"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = lang_id.identify(docs, lang_id.fit(docs.filter(fold(4) != 2)), with_spans=False)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_personal_data": op2_personal_data,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_fingerprints": op4_fingerprints,
        "op5_toxicity": op5_toxicity,
        "op6_secrets": op6_secrets,
        "op7_decontamination": op7_decontamination,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_bpe_encoding": op9_bpe_encoding,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_secrets": secrets_sql(),
    }
