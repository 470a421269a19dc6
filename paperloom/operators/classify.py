"""Keyword classes, known issuers, message intents and commands (C-01 ... C-13)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import (
    capture, contains_any, dialect, first_group, first_match, group_numbers, let, literal_map, strip,
)
from paperloom.sources.files import extension

CLASS = "struct<category:string,confidence:double>"


def _label(category: str, confidence: float) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))


def classify_keywords(text: Column, filename: Column) -> Column:
    """C-01: struct(category, confidence). Rule order decides; the file name is tried before the text."""

    def decide(hay: Column) -> Column:
        by_name = [(contains_any(hay["name"], words), _label(c, rules.FILENAME_CONFIDENCE)) for c, words in rules.KEYWORD_RULES]
        by_text = [(contains_any(hay["all"], words), _label(c, rules.TEXT_CONFIDENCE)) for c, words in rules.KEYWORD_RULES]
        return first_match(by_name + by_text, _label("other", 0.0))

    name = F.lower(F.coalesce(filename, F.lit("")))
    both = F.concat(name, F.lit(" "), F.lower(F.coalesce(text, F.lit(""))))
    return let(F.struct(name.alias("name"), both.alias("all")), decide)


def parse_class_answer(answer: Column) -> Column:
    """C-03: struct(category, confidence) from a model's reply; anything unusable is ('other', 0.0)."""
    body = F.from_json(F.regexp_extract(answer, r"\{[^}]+\}", 0), "category string, confidence string")

    def checked(b: Column) -> Column:
        category = F.coalesce(b["category"], F.lit("other"))
        number = F.coalesce(b["confidence"], F.lit("0.0")).try_cast("double")
        known = category.isin(rules.CATEGORIES) & number.isNotNull()
        return F.when(
            F.coalesce(known, F.lit(False)), F.struct(category.alias("category"), number.alias("confidence"))
        ).otherwise(_label("other", 0.0))

    return let(body, checked)


def classify_documents(df: DataFrame, answer: str | None = None, known: Column | None = None) -> DataFrame:
    """C-02: keywords first; spreadsheets by name only; a model's answer only where keywords found nothing.

    Needs raw_text and filename; ``answer`` names the column with the model's reply, if there is one. Where ``known`` holds, the
    text is not looked at and the class is NULL.
    """
    sheet = extension(F.col("filename")).isin(rules.SPREADSHEET_EXTENSIONS)
    by_rule = classify_keywords(F.when(~sheet, F.col("raw_text")), F.col("filename"))
    reply = parse_class_answer(F.coalesce(F.col(answer), F.lit(""))) if answer else _label("other", 0.0)

    def settle(r: Column) -> Column:
        return first_match(
            [(r["confidence"] >= rules.CLASSIFIER_ACCEPT, r.cast(CLASS)), (sheet, _label("other", 0.3).cast(CLASS))],
            reply.cast(CLASS),
        )

    settled = let(by_rule, settle)
    return df.withColumn("class", settled if known is None else F.when(~known, settled))


def electricity_metadata(text: Column, filename: Column) -> Column:
    """C-05: the first date of the period pair is its end."""
    f = rules.ELECTRICITY_FIELDS
    stem = F.regexp_replace(filename, r"\..*$", "")
    return F.create_map(
        F.lit("issuer_account_number"), first_group(text, f["issuer_account_number"]),
        F.lit("issuer_bill_number"), F.coalesce(first_group(text, f["issuer_bill_number"]), stem),
        F.lit("issuer_issue_date"), first_group(text, f["issuer_issue_date"]),
        F.lit("issuer_period_end"), capture(text, rules.ELECTRICITY_PERIOD, 1),
        F.lit("issuer_period_start"), capture(text, rules.ELECTRICITY_PERIOD, 2),
    )


def water_metadata(text: Column) -> Column:
    """C-06."""
    pairs = [x for name, patterns in rules.WATER_FIELDS.items() for x in (F.lit(name), first_group(text, patterns))]
    return F.create_map(
        *pairs,
        F.lit("issuer_period_start"), capture(text, rules.WATER_PERIOD, 1),
        F.lit("issuer_period_end"), capture(text, rules.WATER_PERIOD, 2),
    )


def resolve_issuer(text: Column, filename: Column) -> Column:
    """C-04: struct for the first known issuer with both lead markers and any further one, else NULL."""

    def decide(hay: Column) -> Column:
        cases = []
        for issuer in rules.ISSUERS:
            lead, rest = issuer["markers"][:2], issuer["markers"][2:]
            hit = hay.contains(lead[0]) & hay.contains(lead[1]) & contains_any(hay, rest)
            found = electricity_metadata(text, filename) if issuer["service_type"] == "electricity" else water_metadata(text)
            fixed = literal_map({k: issuer[k] for k in ("provider_slug", "provider_name", "service_type")} | {"resolver_name": issuer["name"]})
            cases.append(
                (
                    hit,
                    F.struct(
                        F.lit(issuer["doc_type"]).alias("doc_type"), F.lit(rules.ISSUER_CONFIDENCE).alias("confidence"),
                        F.lit(issuer["record_type"]).alias("record_type"), F.lit(issuer["routing_key"]).alias("routing_key"),
                        F.map_concat(fixed, F.map_filter(found, lambda k, v: v.isNotNull())).alias("metadata"),
                    ),
                )
            )
        return first_match(cases)

    return let(F.lower(F.concat(filename, F.lit("\n"), F.coalesce(text, F.lit("")))), decide)


def resolve_or_classify(df: DataFrame, answer: str | None = None) -> DataFrame:
    """C-07: a known issuer wins over the classifier; adds category, class_confidence, issuer, routing_source."""
    both = classify_documents(df.withColumn("issuer", resolve_issuer(F.col("raw_text"), F.col("filename"))), answer, F.col("issuer").isNotNull())
    return both.withColumns(
        {
            "category": F.coalesce("issuer.doc_type", "class.category"),
            "class_confidence": F.coalesce("issuer.confidence", "class.confidence"),
            "routing_source": F.when(F.col("issuer").isNotNull(), F.lit("resolver")),
        }
    ).drop("class")


def message_intent(message: Column, last_entity_type: Column | None = None) -> Column:
    """C-08: the first group with a hit; a message after a document stays with documents; else chat."""

    def decide(text: Column) -> Column:
        cases = [(text.rlike(dialect(p, ignore_case=False)), F.lit(group)) for group, p in rules.INTENT_PATTERNS]
        if last_entity_type is not None:
            cases.append((last_entity_type == "document", F.lit("documents")))
        return first_match(cases, F.lit("chat"))

    return let(F.lower(F.coalesce(message, F.lit(""))), decide)


def parse_command(message: Column, has_media: Column | None = None) -> Column:
    """C-09: struct(skill, action, params); NULL where no command matches.

    The position of the first matching pattern is found once; its parameters are then read by position.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def command(skill: str, action: str, params: Column = none) -> Column:
        return F.struct(F.lit(skill).alias("skill"), F.lit(action).alias("action"), params.alias("params"))

    def params_of(text: Column, pattern: str) -> Column:
        groups = group_numbers(pattern)
        if not groups:
            return none
        pairs = [x for name, number in groups.items() for x in (F.lit(name), capture(text, pattern, number))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    def decide(text: Column) -> Column:
        position = first_match([(text.rlike(dialect(p)), F.lit(i)) for i, (_, p, _) in enumerate(rules.COMMAND_PATTERNS)])
        by_position = lambda at: first_match(
            [(at == i, command(skill, action, params_of(text, p))) for i, (skill, p, action) in enumerate(rules.COMMAND_PATTERNS)]
        )
        return first_match(
            [
                (text.rlike(dialect(rules.CANCEL_COMMAND)), command("system", "cancel")),
                (text.rlike(dialect(rules.CONFIRM_COMMAND)), command("system", "confirm")),
            ],
            let(position, by_position),
        )

    parsed = let(strip(message), decide)
    return parsed if has_media is None else F.when(has_media, command("document", "save")).otherwise(parsed)


def escalation(message: Column) -> Column:
    """C-10: struct(trigger, tier) of the first matching pattern, else NULL."""
    return first_match(
        [
            (message.rlike(dialect(p)), F.struct(F.lit(trigger).alias("trigger"), F.lit(tier).alias("tier")))
            for p, trigger, tier in rules.ESCALATION_PATTERNS
        ]
    )


def feature_request(message: Column, is_admin: Column, assistant_name: str | None = None) -> Column:
    """C-10: kind of a feature request by an admin; ``assistant_name`` adds 'I want <name> to'."""
    patterns = list(rules.FEATURE_REQUEST_PATTERNS)
    if assistant_name:
        patterns.append((f"I want {assistant_name} to", "dev_plan"))
    return F.when(is_admin, first_match([(message.rlike(dialect(p)), F.lit(kind)) for p, kind in patterns]))


def reply_flags(message: Column) -> Column:
    """C-10: struct(confirm, decline, completion) for whole-message replies."""
    return let(
        strip(message),
        lambda m: F.struct(
            m.rlike(dialect(rules.UPGRADE_CONFIRM)).alias("confirm"),
            m.rlike(dialect(rules.UPGRADE_DECLINE)).alias("decline"),
            m.rlike(dialect(rules.COMPLETION_PHRASE)).alias("completion"),
        ),
    )


def worth_remembering(message: Column) -> Column:
    """C-12."""
    return contains_any(message, rules.NUDGE_PHRASES) | let(F.lower(strip(message)), lambda m: contains_any(m, rules.NUDGE_PHRASES))


def question_field(question: Column) -> Column:
    """C-13: the catalog field a question asks for; the first contained keyword decides."""
    return let(F.lower(question), lambda q: first_match([(q.contains(word), F.lit(field)) for word, field in rules.QUESTION_FIELDS]))
