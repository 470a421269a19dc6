"""Operators on the real corpus: masking (S-16 ... S-18) and text quality (X-07, X-08)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.pii import has_pii, mask_pii, pii_counts, restore_pii
from paperloom.functions.quality import quality_band, quality_score
from paperloom.suite.registry import query
from paperloom.suite.shapes import texts


def _mask_sql() -> str:
    """The ordered masks as one chain of CTEs: split at the matches, join the pieces around placeholders."""
    steps = ["t0 AS (SELECT doc_id, text AS original, text AS t, 0 AS n_phone, CAST([] AS VARCHAR[]) AS kinds FROM documents)"]
    for i, (pattern, label, kind) in enumerate(rules.PII_PATTERNS, start=1):
        p = pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")
        offset = "n_phone" if kind == "phone" else "0"
        steps.append(
            f"""t{i} AS (SELECT doc_id, original,
              array_to_string(list_transform(string_split_regex(t, '{p}'),
                lambda x, j: CASE WHEN j <= len(m) THEN x || '[{label}_' || (j + {offset}) || ']' ELSE x END), '') AS t,
              n_phone + {'len(m)' if kind == 'phone' else '0'} AS n_phone,
              list_concat(kinds, list_transform(m, lambda x: '{kind}')) AS kinds
            FROM (SELECT *, regexp_extract_all(t, '{p}') AS m FROM t{i - 1}))"""
        )
    return "WITH " + ",\n".join(steps) + "\n"


@query(
    "s16_mask_pii",
    _mask_sql() + "SELECT doc_id, t AS masked, CAST(len(kinds) AS INTEGER) AS n, array_to_string(kinds, ',') AS kinds FROM t6",
)
def s16(spark, sf):
    masked = mask_pii(texts(spark, sf))
    return masked.select(
        "doc_id", "masked", F.size("pii_records").alias("n"), F.array_join(F.col("pii_records.pattern_type"), ",").alias("kinds")
    )


@query("s17_restore_pii", "SELECT doc_id, text AS restored FROM documents")
def s17(spark, sf):
    masked = mask_pii(texts(spark, sf))
    return masked.select("doc_id", restore_pii(F.col("masked"), F.col("pii_records")).alias("restored"))


@query(
    "s18_pii_counts",
    _mask_sql() + "SELECT pattern_type, count(*) AS n FROM (SELECT unnest(kinds) AS pattern_type FROM t6) GROUP BY 1",
)
def s18_counts(spark, sf):
    return pii_counts(mask_pii(texts(spark, sf)))


@query(
    "s18_pii_flag",
    _mask_sql() + "SELECT doc_id, len(kinds) > 0 AS has_pii FROM t6",
)
def s18_flag(spark, sf):
    masked = mask_pii(texts(spark, sf))
    return masked.select("doc_id", has_pii(F.col("pii_records")).alias("has_pii"))


def _quality_sql(column: str = "text", source: str = "documents", key: str = "doc_id", lang: str = "heb") -> str:
    script = (
        "CASE WHEN heb / greatest(alpha, 1) >= 0.4 THEN 1.0 WHEN heb / greatest(alpha, 1) >= 0.2 THEN 0.6 WHEN heb / greatest(alpha, 1) >= 0.05 THEN 0.3 ELSE 0.1 END"
        if lang == "heb"
        else "0.5"
    )
    return f"""
    SELECT {key}, CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE
        CAST({script} AS DOUBLE) * 0.4::DOUBLE
      + CAST(CASE WHEN solid / greatest(words, 1) BETWEEN 2.5 AND 10 THEN 1.0 WHEN solid / greatest(words, 1) BETWEEN 1.5 AND 15 THEN 0.5 ELSE 0.1 END AS DOUBLE) * 0.2::DOUBLE
      + CAST(CASE WHEN noise / greatest(chars, 1) < 0.05 THEN 1.0 WHEN noise / greatest(chars, 1) < 0.15 THEN 0.5 ELSE 0.1 END AS DOUBLE) * 0.25::DOUBLE
      + CAST(CASE WHEN lines >= 3 THEN 1.0 WHEN lines = 2 THEN 0.7 WHEN chars < 100 THEN 0.6 ELSE 0.3 END AS DOUBLE) * 0.15::DOUBLE END AS quality
    FROM (
      SELECT {key}, length(t) AS chars,
        CAST(len(regexp_extract_all(t, '[֐-׿]')) AS DOUBLE) AS heb, len(regexp_extract_all(t, '\\p{{L}}')) AS alpha,
        CAST(length(regexp_replace(t, '[\\s\\p{{Z}}]+', '', 'g')) AS DOUBLE) AS solid,
        len(regexp_extract_all(t, '[^\\s\\p{{Z}}]+')) AS words,
        CAST(length(t) - length(regexp_replace(t, '(?i)[bcdfghjklmnpqrstvwxyz]{{5,}}', '', 'g')) AS DOUBLE) AS noise,
        length(t) - length(replace(t, chr(10), '')) + 1 AS lines
      FROM (SELECT {key}, regexp_replace({column}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS t FROM {source}))"""


@query("x07_quality_score", _quality_sql())
def x07(spark, sf):
    return texts(spark, sf).select("doc_id", quality_score(F.col("text")).alias("quality"))


@query("x07_quality_score_neutral", _quality_sql(lang="other"))
def x07_neutral(spark, sf):
    return texts(spark, sf).select("doc_id", quality_score(F.col("text"), lang="other").alias("quality"))


@query(
    "x08_quality_band",
    f"""SELECT CASE WHEN quality >= 0.5 THEN 'GOOD' WHEN quality >= 0.3 THEN 'BORDERLINE' ELSE 'LOW' END AS band, count(*) AS n
    FROM ({_quality_sql()}) GROUP BY 1""",
)
def x08(spark, sf):
    scored = texts(spark, sf).select(quality_score(F.col("text")).alias("quality"))
    return scored.groupBy(quality_band(F.col("quality")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
