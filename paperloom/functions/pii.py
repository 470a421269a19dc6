"""Personal-data masking with indexed placeholders, and its inverse (S-16 ... S-18)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import dialect, let

RECORDS = "array<struct<original:string,placeholder:string,pattern_type:string>>"


def _java(pattern: str) -> str:
    """What stands before an @ gives nothing back: its class holds no @, so the possessive form matches the same, in linear time."""
    return dialect(pattern, ignore_case=False).replace("]+@", "]++@")


def _possible(text: Column, kind: str) -> Column:
    """A cheap necessary condition: an address has an '@', every other kind four digits in a row."""
    return text.contains("@") if kind == "email" else text.rlike("[0-9]{4}")


def _mask_step(state: Column, pattern: str, label: str, kind: str) -> Column:
    """Replace every match of one pattern; ``state`` carries the text and the records so far."""
    found = let(
        state,
        lambda s: F.struct(
            s["text"].alias("text"),
            s["records"].alias("records"),
            F.when(_possible(s["text"], kind), F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)))
            .otherwise(F.array().cast("array<string>"))
            .alias("hits"),
            # a label shared by two patterns keeps one running number
            F.size(F.filter(s["records"], lambda r: r["placeholder"].startswith(f"[{label}_"))).alias("used"),
        ),
    )

    def replaced(s: Column) -> Column:
        placeholder = lambda i: F.concat(F.lit(f"[{label}_"), (s["used"] + i + 1).cast("string"), F.lit("]"))
        pieces = F.transform(
            F.split(s["text"], pattern, -1),
            lambda x, i: F.when(i < F.size(s["hits"]), F.concat(x, placeholder(i))).otherwise(x),
        )
        records = F.transform(
            s["hits"],
            lambda m, i: F.struct(m.alias("original"), placeholder(i).alias("placeholder"), F.lit(kind).alias("pattern_type")),
        )
        none = F.size(s["hits"]) == 0
        return F.struct(
            F.when(none, s["text"]).otherwise(F.array_join(pieces, "")).alias("text"),
            F.when(none, s["records"]).otherwise(F.concat(s["records"], records)).alias("records"),
        )

    return let(found, replaced)


def masked_text(text: Column) -> Column:
    """S-16: struct(text, records) after the ordered patterns; most texts stop at the cheap condition."""
    start = F.struct(text.alias("text"), F.array().cast(RECORDS).alias("records"))
    state = start
    for pattern, label, kind in rules.PII_PATTERNS:
        state = _mask_step(state, _java(pattern), label, kind)
    return F.when(_possible(text, "email") | _possible(text, "digits"), state).otherwise(start)


def mask_pii(df: DataFrame, text: str = "text", out: str = "masked", records: str = "pii_records") -> DataFrame:
    """S-16 on a table: adds the cleaned text and the replacement records."""
    masked = df.withColumn("_masked", masked_text(F.col(text)))
    return masked.withColumns({out: F.col("_masked.text"), records: F.col("_masked.records")}).drop("_masked")


def restore_pii(text: Column, records: Column) -> Column:
    """S-17: put the originals back, one occurrence per record, in record order."""

    def put_back(acc: Column, record: Column) -> Column:
        at = F.position(record["placeholder"], acc)
        return F.when(at > 0, F.overlay(acc, record["original"], at, F.length(record["placeholder"]))).otherwise(acc)

    return F.aggregate(records, text, put_back)


def has_pii(records: Column) -> Column:
    """S-18."""
    return F.size(records) > 0


def pii_counts(masked: DataFrame, records: str = "pii_records") -> DataFrame:
    """S-18: how many values of each type were masked."""
    return (
        masked.select(F.explode_outer(F.col(records)).alias("record"))
        .filter(F.col("record").isNotNull())
        .groupBy(F.col("record.pattern_type").alias("pattern_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
