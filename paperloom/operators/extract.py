"""Facts from text and from model answers (F-01 ... F-12)."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import (
    dialect, first_match, let, literal_array, non_blank, strip,
)
from paperloom.functions.scalars import chunk_text, excerpt

FACT = "struct<fact_key:string,fact_value:string,confidence:double,source_excerpt:string>"


def _fact(key: str, value: Column, confidence: float, text: Column) -> Column:
    return F.struct(
        F.lit(key).alias("fact_key"), value.alias("fact_value"), F.lit(confidence).alias("confidence"), text.alias("source_excerpt")
    )


def _around(text: Column, start: Column, length: Column, margin: int) -> Column:
    """The text around [start, start + length), zero-based, cut at the text's ends."""
    first = F.greatest(start - margin, F.lit(0))
    return F.substring(text, first + 1, start + length + margin - first)


def _before_first(text: Column, pattern: str) -> Column:
    """The text before a pattern's first match. ``split`` would compile the pattern anew for every row."""
    flags, body = re.match(r"(\(\?[a-z]+\))(.*)", pattern, re.S).groups()
    return F.regexp_extract(text, rf"{flags}^((?s:.*?))(?:{body})", 1)


def date_fact(text: Column) -> Column:
    """F-01: the first date by pattern priority, else NULL.

    Offsets are lengths of the text before the match, so they count characters like ``substring`` does.
    """

    def found(pattern: str) -> Column:
        value = F.regexp_extract(text, pattern, 1)
        before = F.length(_before_first(text, pattern))
        near = excerpt(strip(_around(text, before, F.length(value), rules.DATE_EXCERPT_MARGIN)))
        return _fact("source_date", value, rules.DATE_CONFIDENCE, near)

    patterns = [dialect(p, ignore_case=False) for p in rules.DATE_PATTERNS]
    return first_match([(text.rlike(p), found(p)) for p in patterns])


def amount_facts(text: Column) -> Column:
    """F-02: array of an amount fact and a currency fact for the first amount that has digits; empty if none."""
    flags, body = re.match(r"(\(\?[a-z]+\))(.*)", dialect(rules.AMOUNT_PATTERN), re.S).groups()
    pattern = f"{flags}{rules.AMOUNT_START}(?:{body})"  # one look rules most characters out, before all the signs are tried

    def amount_of(hit: Column) -> Column:
        digits = F.coalesce(non_blank(F.regexp_extract(hit, pattern, 1)), F.regexp_extract(hit, pattern, 2))
        return F.replace(digits, F.lit(","), F.lit(""))

    def locate(hits: Column) -> Column:
        amounts = F.transform(hits, amount_of)
        index = F.array_position(F.transform(amounts, lambda a: a != ""), True).cast("int") - 1
        return F.struct(hits.alias("hits"), amounts.alias("amounts"), index.alias("at"))

    def facts(p: Column) -> Column:
        near = _around(text, p["start"], p["size"], rules.CURRENCY_MARGIN)
        currency = let(near, lambda c: first_match([(c.contains(s), F.lit(code)) for s, code in rules.CURRENCY_SYMBOLS], F.lit(rules.DEFAULT_CURRENCY)))
        around = excerpt(strip(_around(text, p["start"], p["size"], rules.AMOUNT_EXCERPT_MARGIN)))
        both = lambda quote: F.array(_fact("amount", p["amount"], rules.AMOUNT_CONFIDENCE, quote), _fact("currency", currency, rules.AMOUNT_CONFIDENCE, quote))
        return let(around, both)

    place = lambda before, size, amount: F.struct(F.length(before).alias("start"), size.alias("size"), amount.alias("amount"))
    none = F.array().cast(f"array<{FACT}>")

    def later(m: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), m["at"] + 1)
        before = F.array_join(F.transform(pieces, lambda x, i: F.when(i < m["at"], F.concat(x, F.get(m["hits"], i))).otherwise(x)), "")
        return F.when(m["at"] >= 0, let(place(before, F.length(F.get(m["hits"], m["at"])), F.get(m["amounts"], m["at"])), facts)).otherwise(none)

    def first(amount: Column) -> Column:
        """Nearly always the first hit has digits: the others are looked for only if it has none."""
        at_once = let(place(_before_first(text, pattern), F.length(F.regexp_extract(text, pattern, 0)), amount), facts)
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(amount != "", at_once).otherwise(let(let(hits, locate), later))

    return F.when(text.rlike(pattern), let(amount_of(text), first)).otherwise(none)


def regex_facts(text: Column) -> Column:
    """F-01 + F-02 in extraction order; empty for a blank text."""
    none = F.array().cast(f"array<{FACT}>")
    both = F.concat(F.array_compact(F.array(date_fact(text))).cast(f"array<{FACT}>"), amount_facts(text).cast(f"array<{FACT}>"))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", none).otherwise(both)


def fact_rows(documents: DataFrame, facts: str = "facts", doc_type: str = "doc_type") -> DataFrame:
    """F-12: an array of facts per document -> fact rows with their position and defaults."""
    # the outer form keeps the array from being computed again for a pushed-down emptiness test
    exploded = documents.select(
        F.col("doc_id").alias("document_id"), F.col(doc_type).alias("fact_type"), F.posexplode_outer(facts).alias("fact_seq", "f")
    ).filter(F.col("f").isNotNull())
    return exploded.select(
        "document_id", F.col("fact_seq").cast("long").alias("fact_seq"), "fact_type", "f.fact_key", "f.fact_value",
        F.coalesce("f.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("f.source_excerpt", F.lit("")).alias("source_excerpt"),
    )


def remaining_keys(doc_type: Column, found: Column) -> Column:
    """F-03: keys still to be looked for, in the category's order."""
    table = F.create_map(*[x for c, keys in rules.CATEGORY_FACT_KEYS.items() for x in (F.lit(c), literal_array(keys))])
    wanted = F.coalesce(F.try_element_at(table, doc_type), literal_array(rules.CATEGORY_FACT_KEYS["other"]))
    return F.array_except(wanted, found)


def extraction_plan(documents: DataFrame) -> DataFrame:
    """F-04: what to ask a model for: one row per (document, chunk) with mode, keys and that chunk's text.

    ``documents``: doc_id, doc_type, raw_text, text_quality, found_keys. Modes: none (blank text), regex_only (poor text or nothing left to find), recipe, chunked, single.
    """
    keys = remaining_keys(F.col("doc_type"), F.col("found_keys"))
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    mode = first_match(
        [
            (strip(text) == "", F.lit("none")),
            (F.col("text_quality") < rules.MIN_TEXT_QUALITY, F.lit("regex_only")),
            (F.col("doc_type") == "recipe", F.lit("recipe")),
            (F.size(keys) == 0, F.lit("regex_only")),
            (F.length(text) > rules.LARGE_TEXT_CHARS, F.lit("chunked")),
        ],
        F.lit("single"),
    )
    planned = documents.select("doc_id", text.alias("_text"), mode.alias("mode"), keys.alias("_keys"))
    ask = F.col("mode").isin("recipe", "chunked", "single")
    chunks = F.when(F.col("mode") == "chunked", chunk_text(F.col("_text"))).otherwise(F.array(F.when(ask, F.col("_text"))))
    rows = planned.select(
        "doc_id", "mode",
        first_match(
            [(F.col("mode") == "recipe", literal_array(rules.RECIPE_KEYS)), (ask, F.col("_keys"))], F.array().cast("array<string>")
        ).alias("keys"),
        F.posexplode(chunks).alias("chunk_id", "chunk"),
    )
    return rows


def _json_array(answer: Column) -> Column:
    """The outermost [...] of a reply, across lines."""
    return F.regexp_extract(answer, r"(?s)\[.*\]", 0)


_ANSWER_FACTS = "array<struct<fact_key:string,fact_value:string,confidence:string,source_excerpt:string>>"


def answer_items(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Facts as a model listed them, with their position; broken JSON gives no rows.

    ``answers``: document_id, fact_type, chunk_id, <answer>.
    """
    listed = answers.select(
        "document_id", "fact_type", "chunk_id", F.posexplode_outer(F.from_json(_json_array(F.col(answer)), _ANSWER_FACTS)).alias("pos", "f")
    )
    return listed.select(
        "document_id", "fact_type", (F.col("chunk_id").cast("long") * 1_000_000 + F.col("pos")).alias("fact_seq"), "f.fact_key",
        strip(F.coalesce("f.fact_value", F.lit(""))).alias("fact_value"),
        F.coalesce("f.confidence", F.lit("0.5")).try_cast("double").alias("confidence"),
        excerpt(F.coalesce("f.source_excerpt", F.lit(""))).alias("source_excerpt"),
    ).filter(F.col("fact_key").isin(rules.FACT_KEYS) & (F.col("fact_value") != ""))


def single_answer_facts(items: DataFrame, found: DataFrame) -> DataFrame:
    """F-05: first value per key, without the keys the regexes already found (``found``: document_id, fact_key)."""
    row = F.struct("fact_type", "fact_seq", "fact_value", "confidence", "source_excerpt")
    first = items.groupBy("document_id", "fact_key").agg(F.min_by(row, "fact_seq").alias("r")).select("document_id", "fact_key", "r.*")
    return first.join(found.select("document_id", "fact_key").distinct(), ["document_id", "fact_key"], "left_anti")


def merge_chunk_facts(items: DataFrame) -> DataFrame:
    """F-06: best confidence per key; multi-value keys keep every distinct value in order of appearance.

    Repeats of a value fold before values are gathered, so only distinct values of one key meet.
    """
    usable = items.withColumn("fact_value", strip(F.col("fact_value"))).filter(
        F.col("fact_key").isin(rules.FACT_KEYS) & (F.col("fact_value") != "")
    )
    multi = F.col("fact_key").isin(rules.MULTI_VALUE_KEYS)
    row = F.struct("fact_type", "fact_value", "confidence", "source_excerpt")
    scalar = (
        usable.filter(~multi).groupBy("document_id", "fact_key")
        .agg(F.max_by(row, F.struct(F.col("confidence"), -F.col("fact_seq"))).alias("r"), F.min("fact_seq").alias("fact_seq"))
        .select("document_id", "fact_key", "fact_seq", "r.*")
    )
    values = usable.filter(multi).groupBy("document_id", "fact_key", "fact_value").agg(
        F.min_by(F.struct("fact_type", "confidence", "source_excerpt"), "fact_seq").alias("r"), F.min("fact_seq").alias("fact_seq")
    )
    joined = values.groupBy("document_id", "fact_key").agg(
        F.min("fact_seq").alias("fact_seq"),
        F.min_by("r.fact_type", "fact_seq").alias("fact_type"),
        F.array_join(F.array_sort(F.collect_list(F.struct("fact_seq", "fact_value")))["fact_value"], "; ").alias("fact_value"),
        F.max("r.confidence").alias("confidence"),
        F.min_by("r.source_excerpt", "fact_seq").alias("source_excerpt"),
    )
    return scalar.unionByName(joined)


def recipe_facts(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """F-07: recipes of a reply -> fact rows; the excerpt names the recipe only where there are several.

    ``answers``: document_id, <answer>.
    """
    fields = ",".join(f"{k}:string" for k in rules.RECIPE_KEYS)
    listed = answers.select("document_id", F.from_json(_json_array(F.col(answer)), f"array<struct<{fields}>>").alias("recipes"))
    one = listed.select("document_id", (F.size("recipes") > 1).alias("many"), F.posexplode_outer("recipes").alias("no", "r"))
    name = strip(F.coalesce("r.recipe_name", F.lit("")))
    quote = F.when(F.col("many"), excerpt(name)).otherwise(F.lit(""))
    facts = F.array(
        *[
            F.struct(
                F.lit(k).alias("fact_key"), strip(F.coalesce(F.col(f"r.{k}"), F.lit(""))).alias("fact_value"),
                F.lit(rules.RECIPE_CONFIDENCE[k]).alias("confidence"), quote.alias("source_excerpt"),
            )
            for k in rules.RECIPE_KEYS
        ]
    )
    rows = one.filter(name != "").select("document_id", "no", F.posexplode_outer(facts).alias("pos", "f"))
    return rows.filter(F.col("f.fact_value") != "").select(
        "document_id", (F.col("no").cast("long") * len(rules.RECIPE_KEYS) + F.col("pos")).alias("fact_seq"),
        F.lit("recipe").alias("fact_type"), "f.*",
    )


def salary_payload(answer: Column) -> Column:
    """F-08: struct of the salary keys and a clamped confidence; NULL where the reply holds no JSON object."""
    schema = ", ".join(f"{k} string" for k in [*rules.SALARY_KEYS, "confidence"])

    def coerce(p: Column) -> Column:
        texts = [strip(p[k]).alias(k) for k in rules.SALARY_TEXT_KEYS]
        money = [p[k].try_cast("double").alias(k) for k in rules.SALARY_MONEY_KEYS]
        sure = F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0))
        return F.struct(*texts, *money, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))

    parsed = lambda body: F.when(F.try_parse_json(body).isNotNull(), let(F.from_json(body, schema), coerce))
    return let(F.regexp_extract(answer, r"(?s)\{.*\}", 0), parsed)


def strong_enough(payload: Column) -> Column:
    """F-09: confident and all critical fields present."""
    present = [payload[k].isNotNull() for k in rules.SALARY_CRITICAL_KEYS]
    strong = (payload["confidence"] >= rules.SALARY_STRONG_CONFIDENCE) & present[0] & present[1] & present[2]
    return F.coalesce(payload.isNotNull() & strong, F.lit(False))


def better_payload(first: Column, second: Column) -> Column:
    """F-09: struct(payload, model): the first pass if strong, else the second if strong or at least as confident."""
    sure = lambda p: F.coalesce(p["confidence"], F.lit(0.0))

    def choose(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        use_b = ~strong_enough(a) & b.isNotNull() & (strong_enough(b) | (sure(b) >= sure(a)))
        label_a, label_b = rules.SALARY_PASS_LABELS
        return F.struct(F.when(use_b, b).otherwise(a).alias("payload"), F.when(use_b, F.lit(label_b)).otherwise(F.lit(label_a)).alias("model"))

    return let(F.struct(first.alias("a"), second.alias("b")), choose)


def plain_number(value: Column) -> Column:
    """A double as decimal text with at least one decimal, never in exponent form."""
    text = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.regexp_replace(text, r"\.$", ".0")


def payload_fact_array(payload: Column) -> Column:
    """F-10 inside the slip's own row: the present fields as an array of facts, empty without a payload."""
    value = lambda k: payload[k] if k in rules.SALARY_TEXT_KEYS else plain_number(payload[k])
    fields = F.array(
        *[
            F.struct(F.lit(k).alias("fact_key"), value(k).alias("fact_value"), payload["confidence"].alias("confidence"), F.lit("").alias("source_excerpt"))
            for k in rules.SALARY_KEYS
        ]
    ).cast(f"array<{FACT}>")
    return F.coalesce(F.when(payload.isNotNull(), F.filter(fields, lambda f: f["fact_value"].isNotNull())), F.array().cast(f"array<{FACT}>"))


def payload_facts(slips: DataFrame, payload: str = "payload") -> DataFrame:
    """F-10: the present fields of a payload as fact rows, all with the payload's confidence."""
    p = F.col(payload)
    value = lambda k: p[k] if k in rules.SALARY_TEXT_KEYS else plain_number(p[k])
    fields = F.array(*[F.struct(F.lit(k).alias("fact_key"), value(k).alias("fact_value")) for k in rules.SALARY_KEYS])
    rows = slips.filter(p.isNotNull()).select(
        F.col("doc_id").alias("document_id"), p["confidence"].alias("confidence"), F.posexplode_outer(fields).alias("pos", "f")
    )
    return rows.filter(F.col("f.fact_value").isNotNull()).select(
        "document_id", F.col("pos").cast("long").alias("fact_seq"), F.lit("salary_slip").alias("fact_type"), "f.fact_key", "f.fact_value",
        "confidence", F.lit("").alias("source_excerpt"),
    )


def payload_metadata(payload: Column, model: Column) -> Column:
    """F-10: JSON with the payload, the confidence per present field and how it was extracted."""
    per_field = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(k), F.when(payload[k].isNotNull(), payload["confidence"]).alias("c")) for k in rules.SALARY_KEYS]),
            lambda e: e["c"].isNotNull(),
        )
    )
    return F.when(
        payload.isNotNull(),
        F.to_json(
            F.struct(
                payload.alias("structured_payload"), per_field.alias("field_confidence"), model.alias("extraction_model"),
                F.lit("v1").alias("extraction_version"),
            )
        ),
    )


def memory_items(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """F-11: memories of a reply that is a JSON list; blank contents are dropped. ``answers``: member_id, <answer>."""
    text = strip(F.col(answer))
    listed = F.from_json(
        F.when(text.startswith("["), text), "array<struct<content:string,category:string,memory_type:string,confidence:string>>"
    )
    rows = answers.select(*[c for c in answers.columns if c != answer], F.posexplode_outer(listed).alias("item_no", "f"))
    return rows.select(
        *[c for c in answers.columns if c != answer], "item_no", strip(F.coalesce("f.content", F.lit(""))).alias("content"),
        F.coalesce("f.category", F.lit("context")).alias("category"), F.coalesce("f.memory_type", F.lit("short")).alias("memory_type"),
        F.coalesce("f.confidence", F.lit("1.0")).try_cast("double").alias("confidence"),
    ).filter(F.col("content") != "")
