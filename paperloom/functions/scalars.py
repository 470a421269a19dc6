"""Money, dates, tags, phones, chunks and message statements (S-01 ... S-27)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import capture, dialect, first_match, let, literal_map, non_blank, strip

MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,3)"


def parse_amount(value: Column, as_type: str = MONEY) -> Column:
    """S-01: drop thousands separators; NULL when it is no number."""
    return strip(F.replace(value, F.lit(","), F.lit(""))).try_cast(as_type)


def parse_int(value: Column) -> Column:
    """S-02."""
    return let(strip(value), lambda v: F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("int")))


def _date_from(year: Column, month: Column, day: Column) -> Column:
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def parse_date(value: Column) -> Column:
    """S-03: ISO (dashed or compact), then D/M/Y, then D.M.Y; a two-digit year is taken literally."""
    shapes = [
        (r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", (1, 2, 3)),
        (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", (1, 2, 3)),
        (r"^([0-9]{1,2})\s*/\s*([0-9]{1,2})\s*/\s*([0-9]{1,4})$", (3, 2, 1)),
        (r"^([0-9]{1,2})\s*\.\s*([0-9]{1,2})\s*\.\s*([0-9]{1,4})$", (3, 2, 1)),
    ]

    def by_shape(text: Column) -> Column:
        return first_match([(text.rlike(p), _date_from(*[F.regexp_extract(text, p, g) for g in groups])) for p, groups in shapes])

    return let(strip(value), by_shape)


def parse_iso_date(value: Column) -> Column:
    """ISO only: the display-name fallback accepts nothing else."""
    p = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$"
    ok = lambda v: v.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})$")
    return let(value, lambda v: F.when(ok(v), _date_from(*[F.regexp_extract(v, p, g) for g in (1, 2, 3)])))


def pay_period(value: Column) -> Column:
    """S-04: struct(pay_year, pay_month) from YYYY-MM or MM-YYYY (separators - / .)."""
    year_first, month_first = r"^([0-9]{4})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2})[-/.]([0-9]{4})$"

    def parts(text: Column) -> Column:
        year = F.coalesce(capture(text, year_first, 1), capture(text, month_first, 2)).try_cast("int")
        month = F.coalesce(capture(text, year_first, 2), capture(text, month_first, 1)).try_cast("int")
        in_year = let(month, lambda m: F.when(m.between(1, 12), m))
        return F.struct(year.alias("pay_year"), in_year.alias("pay_month"))

    return let(strip(value), parts)


def year_tag(doc_date: Column, filename: Column) -> Column:
    """S-06: year of the date, else the first 19xx/20xx token of the file name, else ''."""
    tokens = F.split(F.translate(filename, ".-", "  "), r"\s+")
    token = F.try_element_at(F.filter(tokens, lambda t: t.rlike("^(19|20)[0-9]{2}$")), F.lit(1))
    return F.coalesce(F.year(doc_date).cast("string"), token, F.lit(""))


def normalize_tag(tag: Column) -> Column:
    """S-07."""
    return F.coalesce(F.regexp_replace(F.lower(strip(tag)), "^#", ""), F.lit(""))


def normalize_tags(tags: Column) -> Column:
    """S-08: ordered distinct, empties dropped."""
    clean = F.filter(F.transform(tags, normalize_tag), lambda t: t != "")
    return F.coalesce(F.array_distinct(clean), F.array().cast("array<string>"))


def merge_tags(existing: Column, additions: Column) -> Column:
    """S-09: existing first, then additions, ordered distinct."""
    return F.array_distinct(F.concat(normalize_tags(existing), normalize_tags(additions)))


def chunk_text(text: Column) -> Column:
    """S-10: array of overlapping windows; the tail window may lie inside the one before it."""
    step = rules.CHUNK_CHARS - rules.CHUNK_OVERLAP
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    windows = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(rules.CHUNK_CHARS)))
    return F.when(F.length(text) <= rules.CHUNK_CHARS, F.array(text)).otherwise(windows)


def excerpt(text: Column) -> Column:
    """S-11."""
    return F.substring(text, 1, rules.EXCERPT_CAP)


def normalize_phone(raw: Column) -> Column:
    """S-12: digits before '@'."""
    return F.regexp_replace(F.substring_index(raw, "@", 1), "[^0-9]", "")


def canonical_phone(raw: Column) -> Column:
    """S-13: local ten-digit numbers become international."""
    digits = normalize_phone(raw)
    return F.when(digits.startswith("0") & (F.length(digits) == 10), F.concat(F.lit("972"), F.substring(digits, 2, 9))).otherwise(digits)


def phone_candidates(raw: Column) -> Column:
    """S-14: ordered distinct spellings that may name the same phone."""
    digits = normalize_phone(raw)
    local = F.when(digits.startswith("972") & (F.length(digits) == 12), F.concat(F.lit("0"), F.substring(digits, 4, 9)))
    world = F.when(digits.startswith("0") & (F.length(digits) == 10), F.concat(F.lit("972"), F.substring(digits, 2, 9)))
    plus = lambda c: F.concat(F.lit("+"), c)
    spellings = F.array(
        non_blank(raw), non_blank(F.substring_index(raw, "@", 1)), digits, plus(digits),
        local, plus(local), world, plus(world),
    )
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(digits, F.lit("")) == "", none).otherwise(F.array_distinct(F.array_compact(spellings)))


def valid_phone(phone: Column) -> Column:
    """S-15."""
    return phone.rlike("^(972[0-9]{9}|0[0-9]{9})$")


def audit_text(message: Column, has_pii: Column) -> Column:
    """S-19."""
    short = rules.AUDIT_TEXT_CAP - len(rules.PII_SUFFIX)
    return F.when(has_pii, F.concat(F.substring(message, 1, short), F.lit(rules.PII_SUFFIX))).otherwise(
        F.substring(message, 1, rules.AUDIT_TEXT_CAP)
    )


def normalize_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """S-20: lower/trim, then the household's own alias map."""
    clean = F.lower(strip(F.coalesce(name, F.lit(""))))
    return F.coalesce(F.try_element_at(literal_map(aliases), clean), clean) if aliases else clean


def normalize_member_name(name: Column) -> Column:
    """S-20: collapse white space and drop the two leading prepositions."""
    first, second = rules.ASSIGNEE_PREFIXES
    clean = F.regexp_replace(F.lower(strip(name)), r"\s+", " ")
    return strip(F.regexp_replace(F.regexp_replace(clean, "^" + first, ""), "^" + second, ""))


def fact_category(key: Column) -> Column:
    """S-21."""
    return first_match(
        [
            (key.isin(rules.BASIC_PERSONAL_KEYS), F.lit("basic_personal")),
            (key == "building_code", F.lit("household_access")),
            (key.startswith("health_"), F.lit("health")),
            (key.startswith("financial_"), F.lit("financial")),
        ],
        F.lit("basic_personal"),
    )


def local_time_parts(ts: Column) -> Column:
    """S-22: date parts and display strings for today and tomorrow in the display time zone."""
    local = F.from_utc_timestamp(ts, rules.DISPLAY_TIME_ZONE)
    days = F.array(*[F.lit(d) for d in rules.HEBREW_WEEKDAYS])
    months = F.array(*[F.lit(m) for m in rules.HEBREW_MONTHS])

    def day_name(d: Column) -> Column:
        return F.concat(F.lit("יום "), F.element_at(days, F.weekday(d) + 1))

    def display(d: Column) -> Column:
        return F.concat(
            day_name(d), F.lit(", "), F.dayofmonth(d).cast("string"), F.lit(" ב"),
            F.element_at(months, F.month(d)), F.lit(" "), F.year(d).cast("string"),
        )

    today, tomorrow = F.to_date(local), F.date_add(F.to_date(local), 1)
    return F.struct(
        F.date_format(local, "yyyy-MM-dd").alias("today_date"),
        day_name(today).alias("today_day"),
        display(today).alias("today_display"),
        F.date_format(tomorrow, "yyyy-MM-dd").alias("tomorrow_date"),
        display(tomorrow).alias("tomorrow_display"),
        F.date_format(local, "HH:mm").alias("time"),
        F.hour(local).alias("hour"),
    )


def assignee_shorthand(title: Column) -> Column:
    """S-24: struct(assignee, title); the title is unchanged where the shorthand is absent."""
    p = rules.ASSIGNEE_SHORTHAND
    hit = title.rlike(dialect(p))
    return F.struct(
        F.when(hit, strip(capture(title, p, 1))).alias("assignee"),
        F.when(hit, strip(capture(title, p, 2))).otherwise(title).alias("title"),
    )


def task_changes(text: Column) -> Column:
    """S-25: struct(due_date, priority, title); NULL means unchanged."""
    lowered = F.lower(text)
    priority = first_match([(lowered.contains(word), F.lit(value)) for word, value in rules.PRIORITY_WORDS])
    return F.struct(
        parse_iso_date(capture(text, rules.DUE_DATE_PATTERN, 1, ignore_case=False)).alias("due_date"),
        priority.alias("priority"),
        strip(capture(text, rules.TITLE_PATTERN, 1, ignore_case=False)).alias("title"),
    )


def recurring_request(text: Column) -> Column:
    """S-26: struct(title, frequency, day_of_month) from 'title, frequency[, day]' or a day named in the text."""
    parts = F.transform(F.split(strip(text), ","), strip)
    title, word = F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    third = F.try_element_at(parts, F.lit(3))
    listed = F.when(third.rlike("^[0-9]+$"), third)
    named = capture(F.concat(title, F.lit(" "), word), rules.DAY_OF_MONTH_PATTERN)
    return F.struct(
        title.alias("title"),
        F.coalesce(F.try_element_at(literal_map(rules.FREQUENCY_WORDS), word), F.lit(rules.DEFAULT_FREQUENCY)).alias("frequency"),
        F.coalesce(listed, named).try_cast("int").alias("day_of_month"),
    )


def birth_statement(text: Column) -> Column:
    """S-27: struct(name, birth_date)."""
    return F.struct(capture(text, rules.BIRTH_STATEMENT, 1).alias("name"), capture(text, rules.BIRTH_STATEMENT, 2).alias("birth_date"))


def id_statement(text: Column) -> Column:
    """S-27: struct(name, id_number)."""
    return F.struct(capture(text, rules.ID_STATEMENT, 1).alias("name"), capture(text, rules.ID_STATEMENT, 2).alias("id_number"))


def building_code_statement(text: Column) -> Column:
    """S-27: struct(location, code); the first pattern with a hit decides."""
    first, second = rules.BUILDING_CODE_STATEMENTS
    hit = text.rlike(dialect(first))
    pick = lambda g: F.when(hit, capture(text, first, g)).otherwise(capture(text, second, g))
    return F.struct(strip(pick(1)).alias("location"), pick(2).alias("code"))


def advance_date(day: Column, frequency: Column) -> Column:
    """T-10: next occurrence, clamped to the end of shorter months."""
    return first_match(
        [
            (frequency == "daily", F.date_add(day, 1)),
            (frequency == "weekly", F.date_add(day, 7)),
            (frequency == "monthly", F.add_months(day, 1)),
            (frequency == "yearly", F.add_months(day, 12)),
        ],
        day,
    )


def first_due_date(today: Column, frequency: Column, day_of_month: Column) -> Column:
    """T-12: first due date after ``today``; an unknown frequency counts as monthly."""

    def clamped(base: Column) -> Column:
        day = F.coalesce(F.nullif(day_of_month, F.lit(0)), F.dayofmonth(today))
        return F.date_add(F.trunc(base, "month"), F.least(day, F.dayofmonth(F.last_day(base))) - 1)

    return first_match(
        [
            (frequency == "daily", F.date_add(today, 1)),
            (frequency == "weekly", F.date_add(today, 7)),
            (frequency == "yearly", clamped(F.add_months(today, 12))),
        ],
        clamped(F.add_months(today, 1)),
    )


