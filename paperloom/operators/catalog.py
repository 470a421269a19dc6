"""Search and retrieval over the stored tables (Q-*).

``%`` and ``_`` in a search text keep their wildcard meaning. Newest first always means: creation time
descending with missing times first, then the id, so that pages are stable.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import contains_any, first_match, let, strip
from paperloom.functions.scalars import merge_tags, normalize_tag
from paperloom.operators.access import project_documents, require
from paperloom.operators.classify import question_field

PAGE_MAX = 200


def _newest(ts: str = "created_at", key: str = "doc_id") -> list[Column]:
    return [F.col(ts).desc_nulls_first(), F.col(key).asc()]


def _like(column: str, text: str) -> Column:
    return F.col(column).ilike(f"%{text}%")


def _all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def list_documents(
    documents: DataFrame, role: str, doc_type: str | None = None, vendor: str | None = None, tag: str | None = None,
    review_state: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Q-01: a page of documents with the columns the role may see."""
    found = _all(
        project_documents(documents, role),
        F.col("doc_type") == doc_type if doc_type else None,
        F.col("review_state") == review_state if review_state else None,
        F.array_contains("tags", tag) if tag else None,
        _like("vendor", vendor) if vendor else None,
    )
    return found.orderBy(*_newest()).offset(offset).limit(min(limit, PAGE_MAX))


def document_by_id(documents: DataFrame, role: str, doc_id: int) -> DataFrame:
    """Q-02."""
    return project_documents(documents, role).filter(F.col("doc_id") == doc_id)


def search_facts(
    facts: DataFrame, role: str, fact_key: str | None = None, fact_type: str | None = None, query_text: str | None = None, limit: int = 50
) -> DataFrame:
    """Q-03."""
    require(role, "document_facts", "read")
    found = _all(
        facts,
        F.col("fact_key") == fact_key if fact_key else None,
        F.col("fact_type") == fact_type if fact_type else None,
        _like("fact_value", query_text) if query_text else None,
    )
    return found.orderBy(F.col("created_at").desc_nulls_first(), "document_id", "fact_seq").limit(limit)


def list_salary_slips(slips: DataFrame, role: str, year: int | None = None, employer: str | None = None, limit: int = 50) -> DataFrame:
    """Q-04."""
    require(role, "salary_slips", "read")
    found = _all(slips, F.col("pay_year") == year if year else None, _like("employer_name", employer) if employer else None)
    return found.orderBy(F.col("pay_year").desc_nulls_first(), F.col("pay_month").desc_nulls_first(), "document_id").limit(limit)


def list_utility_bills(bills: DataFrame, role: str, service_type: str | None = None, provider: str | None = None, limit: int = 50) -> DataFrame:
    """Q-05."""
    require(role, "utility_bills", "read")
    found = _all(bills, F.col("service_type") == service_type if service_type else None, _like("provider_name", provider) if provider else None)
    return found.orderBy(*_newest("issue_date", "document_id")).limit(limit)


def _active(end: str, as_of: Column) -> Column:
    return F.col(end).isNull() | (F.col(end) >= as_of)


def list_contracts(
    contracts: DataFrame, role: str, as_of: Column, active_only: bool = False, contract_type: str | None = None, limit: int = 50
) -> DataFrame:
    """Q-06."""
    require(role, "contracts", "read")
    found = _all(contracts, _active("end_date", as_of) if active_only else None, F.col("contract_type") == contract_type if contract_type else None)
    return found.orderBy(*_newest("contract_date", "document_id")).limit(limit)


def list_policies(
    policies: DataFrame, role: str, as_of: Column, active_only: bool = False, insurance_type: str | None = None, limit: int = 50
) -> DataFrame:
    """Q-07."""
    require(role, "insurance_policies", "read")
    found = _all(policies, _active("end_date", as_of) if active_only else None, F.col("insurance_type") == insurance_type if insurance_type else None)
    return found.orderBy(*_newest("policy_date", "document_id")).limit(limit)


def library_stats(documents: DataFrame, typed_tables: dict[str, DataFrame], role: str) -> DataFrame:
    """Q-08: (metric, value) rows: totals, per type, to review, and the size of each typed table; one pass per table."""
    require(role, "documents", "metadata")
    per_type = documents.groupBy(F.coalesce("doc_type", F.lit("other")).alias("doc_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_state") == "needs_review").alias("to_review")
    )
    # a handful of rows from here on
    totals = per_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"), F.coalesce(F.sum("to_review"), F.lit(0)).alias("needs_review"))
    rows = totals.selectExpr("stack(2, 'total_documents', total_documents, 'needs_review', needs_review) AS (metric, value)")
    rows = rows.unionByName(per_type.select(F.concat(F.lit("type:"), F.col("doc_type")).alias("metric"), F.col("n").alias("value")))
    for name, df in typed_tables.items():
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value"))
    return rows


def recent_documents(documents: DataFrame, limit: int = 5) -> DataFrame:
    """Q-09: the newest documents of every uploader, 1 to 20 of them.

    The rank limit is applied before the shuffle as well, so a very active uploader sends few rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("uploaded_by").orderBy(*_newest()))
    return documents.withColumn("position", rank).filter(F.col("position") <= min(max(limit, 1), 20))


def search_documents(
    documents: DataFrame, member: int, doc_type: str | None = None, vendor: str | None = None, keyword: str | None = None,
    review_state: str | None = None, tag: str | None = None, limit: int = 20,
) -> DataFrame:
    """Q-10: a member's documents by any mix of filters."""
    by_word = None
    if keyword:
        by_word = _like("filename", keyword) | _like("display_name", keyword) | _like("raw_text", keyword)
    found = _all(
        documents.filter(F.col("uploaded_by") == member),
        F.col("doc_type") == doc_type if doc_type else None,
        F.col("review_state") == review_state if review_state else None,
        F.exists("tags", lambda t: t == normalize_tag(F.lit(tag))) if tag else None,
        _like("vendor", vendor) if vendor else None,
        by_word,
    )
    return found.orderBy(*_newest()).limit(limit)


def search_by_name(documents: DataFrame, member: int, name: str) -> DataFrame:
    """Q-11: up to ten matches by file or display name with the outcome single / many; no rows = none."""
    text = name.strip()
    own = documents.filter(F.col("uploaded_by") == member)
    found = own.filter(_like("filename", text) | _like("display_name", text)) if text else own.limit(0)
    page = found.orderBy(*_newest()).limit(10)
    # at most ten rows
    return page.withColumn("outcome", F.when(F.count(F.lit(1)).over(Window.partitionBy("uploaded_by")) == 1, F.lit("single")).otherwise(F.lit("many")))


def view(documents: DataFrame, member: int, name: str) -> DataFrame:
    """Q-12: a predefined view."""
    return search_documents(documents, member, **rules.VIEWS.get(name, {}))


def resolve_references(questions: DataFrame, documents: DataFrame, state: DataFrame) -> DataFrame:
    """Q-13: which document a member means: the one in the conversation state, the only one, the newest, or up to five candidates.

    ``questions``: question_id, member_id, question; ``state``: member_id, last_entity_type, last_entity_id.
    """
    slots = documents.select(F.col("uploaded_by").alias("member_id"), "doc_id", "created_at")
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(*_newest()))
    recent = slots.withColumn("position", rank).filter(F.col("position") <= 5).groupBy("member_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "doc_id")))["doc_id"].alias("recent")
    )
    in_state = state.filter(F.col("last_entity_type") == "document").select("member_id", F.col("last_entity_id").alias("doc_id"))
    held = in_state.join(slots.select("member_id", "doc_id"), ["member_id", "doc_id"], "left_semi").withColumnRenamed("doc_id", "held")
    rows = questions.join(recent, "member_id", "left").join(held, "member_id", "left")
    newest = contains_any(F.lower("question"), rules.RECENCY_WORDS)
    first = F.slice("recent", 1, 1)
    chosen = first_match(
        [
            (F.col("held").isNotNull(), F.array("held")), (F.col("recent").isNull(), F.array().cast("array<bigint>")),
            ((F.size("recent") == 1) | newest, first),
        ],
        F.col("recent"),
    )
    how = first_match(
        [
            (F.col("held").isNotNull(), F.lit("state")), (F.col("recent").isNull(), F.lit("none")), (F.size("recent") == 1, F.lit("only")),
            (newest, F.lit("newest")),
        ],
        F.lit("candidates"),
    )
    return rows.select("question_id", "member_id", how.alias("how"), chosen.alias("doc_ids"))


ANSWER = "struct<answer_text:string,source:string,confidence:double,field_used:string>"


def answer_questions(questions: DataFrame, documents: DataFrame, facts: DataFrame, answer: str | None = None) -> DataFrame:
    """Q-14: answer each (question, document): field, period fact, matching fact, recipe path, model answer, not found.

    ``questions``: question_id, doc_id, question[, <answer>]. A document's facts fold to one array of its first
    fact per key before the join; fact keys are a small closed set, so the array is short.
    """
    is_recipe = F.col("fact_type") == "recipe"
    first = facts.groupBy(F.col("document_id").alias("doc_id"), "fact_key").agg(
        F.min_by(F.struct("fact_seq", "fact_value", F.coalesce("confidence", F.lit(0.5)).alias("confidence")), "fact_seq").alias("f"),
        F.max(F.coalesce(is_recipe, F.lit(False))).alias("cooked"), F.min_by("fact_value", F.when(is_recipe, F.col("fact_seq"))).alias("step"),
        F.collect_list(F.when(is_recipe & (F.col("fact_key") == "recipe_name"), F.struct("fact_seq", "fact_value"))).alias("names"),
    )
    of = lambda key, value: F.max(F.when(F.col("fact_key") == key, value))
    folded = first.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("f.fact_seq").alias("seq"), F.col("fact_key").alias("key"), F.col("f.fact_value").alias("value"), F.col("f.confidence").alias("confidence")))).alias("facts"),
        F.when(F.max("cooked"), F.coalesce(of("recipe_name", F.array_sort("names")["fact_value"]), F.array().cast("array<string>"))).alias("dishes"),
        of("instructions", F.col("step")).alias("howto"), of("ingredients", F.col("step")).alias("ingredients"),
    )
    fields = documents.select("doc_id", "doc_type", "vendor", "amount", "doc_date", "ai_summary", "display_name")
    rows = questions.join(fields, "doc_id").join(folded, "doc_id", "left")
    rows = rows.withColumns({"_q": F.lower("question"), "_field": question_field(F.col("question"))})
    q, field = F.col("_q"), F.col("_field")

    def reply(text: Column, source: str, confidence: Column, used: Column) -> Column:
        return F.struct(text.alias("answer_text"), F.lit(source).alias("source"), confidence.alias("confidence"), used.alias("field_used"))

    def from_fact(match: Column) -> Column:
        return F.when(match.isNotNull(), reply(match["value"], "document_fact", match["confidence"], match["key"]))

    stored = first_match([(field == c, F.col(c).cast("string")) for c in ("doc_type", "amount", "vendor", "doc_date", "ai_summary")])
    by_field = let(stored, lambda v: F.when(strip(v) != "", reply(v, "db_field", F.lit(1.0), field)))
    all_facts = F.coalesce("facts", F.array().cast("array<struct<seq:bigint,key:string,value:string,confidence:double>>"))
    period = F.when(field.isin("period_start", "period_end"), from_fact(F.get(F.filter(all_facts, lambda f: f["key"] == field), F.lit(0))))
    by_key = from_fact(F.get(F.filter(all_facts, lambda f: q.contains(f["key"]) | f["key"].contains(q)), F.lit(0)))
    count, dishes, shown = F.size("dishes"), F.array_join("dishes", ", "), F.coalesce("display_name", F.lit(""))
    say = lambda lead: F.concat(F.lit(lead), count.cast("string"), F.lit(" מתכונים ב"), shown, F.lit(": "), dishes)
    used = lambda k: F.lit(k)
    recipe = F.when(
        (F.col("doc_type") == "recipe") & contains_any(q, rules.RECIPE_QUESTION_WORDS),
        first_match(
            [
                (F.col("dishes").isNull(), reply(F.lit(rules.ANSWER_NO_RECIPES), "not_found", F.lit(0.0), F.lit(None).cast("string"))),
                (contains_any(q, rules.RECIPE_LIST_WORDS) & (count > 0), reply(say("יש "), "document_fact", F.lit(0.9), used("recipe_name"))),
                (contains_any(q, rules.RECIPE_HOWTO_WORDS) & F.col("howto").isNotNull(), reply(F.col("howto"), "document_fact", F.lit(0.8), used("instructions"))),
                (q.contains(rules.RECIPE_INGREDIENT_WORD) & F.col("ingredients").isNotNull(), reply(F.col("ingredients"), "document_fact", F.lit(0.8), used("ingredients"))),
                (count > 0, reply(say("נמצאו "), "document_fact", F.lit(0.8), used("recipe_name"))),
            ]
        ),
    )
    steps = [by_field, period, by_key, recipe]
    if answer:
        given = strip(F.col(answer))
        usable = (given != "") & ~given.contains(rules.ANSWER_MODEL_DECLINED)
        steps.append(F.when(usable, reply(given, "llm_grounded", F.lit(0.6), F.lit(None).cast("string"))))
    missing = reply(F.lit(rules.ANSWER_NOT_FOUND), "not_found", F.lit(0.0), F.lit(None).cast("string"))
    result = F.coalesce(*[s.cast(ANSWER) for s in steps], missing.cast(ANSWER))
    return rows.select("question_id", "doc_id", result.alias("a")).select("question_id", "doc_id", "a.*")


def _recipes(facts: DataFrame, key: str) -> DataFrame:
    return facts.filter((F.col("fact_type") == "recipe") & (F.col("fact_key") == key))


def _with_owner(facts: DataFrame, documents: DataFrame, member: int) -> DataFrame:
    own = documents.filter(F.col("uploaded_by") == member).select(F.col("doc_id").alias("document_id"), F.coalesce("display_name", F.lit("")).alias("display_name"))
    return facts.join(own, "document_id")


def list_recipes(facts: DataFrame, documents: DataFrame, member: int) -> DataFrame:
    """Q-15."""
    found = _with_owner(_recipes(facts, "recipe_name"), documents, member)
    return found.select(F.col("fact_value").alias("recipe_name"), "document_id", "display_name")


def search_recipes(facts: DataFrame, documents: DataFrame, member: int, text: str) -> DataFrame:
    """Q-16: recipes by name or ingredient; (document, name) once, a match by name wins.

    An ingredient list names its recipe in the excerpt, else the document's first recipe name is taken.
    """
    wanted = text.strip()
    by_name = _with_owner(_recipes(facts, "recipe_name").filter(_like("fact_value", wanted)), documents, member)
    by_part = _with_owner(_recipes(facts, "ingredients").filter(_like("fact_value", wanted)), documents, member)
    first_name = _recipes(facts, "recipe_name").groupBy("document_id").agg(F.min_by("fact_value", "fact_seq").alias("first_name"))
    part = by_part.join(first_name, "document_id", "left").withColumn(
        "recipe_name", F.when(F.coalesce("source_excerpt", F.lit("")) != "", F.col("source_excerpt")).otherwise(F.col("first_name"))
    )
    both = by_name.select("document_id", F.col("fact_value").alias("recipe_name"), "display_name", F.lit(0).alias("rank")).unionByName(
        part.filter(F.coalesce("recipe_name", F.lit("")) != "").select("document_id", "recipe_name", "display_name", F.lit(1).alias("rank"))
    )
    if not wanted:
        both = both.limit(0)
    best = both.groupBy("document_id", "recipe_name", "display_name").agg(F.min("rank").alias("rank"))
    return best.select("recipe_name", "document_id", "display_name", F.when(F.col("rank") == 0, F.lit("name")).otherwise(F.lit("ingredient")).alias("match_type"))


def recipe_details(facts: DataFrame, documents: DataFrame, member: int, name: str) -> DataFrame:
    """Q-17: the first recipe whose name matches, with its parts as columns; no row when none matches.

    Parts belong to it by the same excerpt (the recipe's name where its own excerpt is empty); the last one wins.
    """
    named = _with_owner(_recipes(facts, "recipe_name").filter(_like("fact_value", name.strip())), documents, member)
    first = named.orderBy("document_id", "fact_seq").limit(1).select(
        "document_id", "display_name", F.col("fact_value").alias("recipe_name"),
        F.when(F.coalesce("source_excerpt", F.lit("")) != "", F.col("source_excerpt")).otherwise(F.col("fact_value")).alias("_excerpt"),
    )
    parts = facts.filter(F.col("fact_type") == "recipe").select("document_id", "fact_key", "fact_value", "source_excerpt", "fact_seq")
    rows = first.join(parts, "document_id", "left")
    mine = F.col("source_excerpt") == F.col("_excerpt")
    return rows.groupBy("document_id", "display_name", "recipe_name").agg(
        *[
            F.max_by("fact_value", F.when(mine & (F.col("fact_key") == k), F.col("fact_seq"))).alias(k)
            for k in rules.RECIPE_KEYS if k != "recipe_name"
        ]
    )


def document_recipes(facts: DataFrame, documents: DataFrame, member: int, doc_id: int) -> DataFrame:
    """Q-18."""
    one = _recipes(facts, "recipe_name").filter(F.col("document_id") == doc_id)
    return _with_owner(one, documents, member).select(F.col("fact_value").alias("recipe_name"), "document_id")


def fallback_search(documents: DataFrame, member: int, text: str, limit: int = 20) -> DataFrame:
    """Q-19: documents for the first word of the list that finds any, else for the text without its question word.

    One scan: a document's rank is that of the first word (or the rest of the text) it contains. The newest of the least ranks
    come out of a top-``limit``, and of these few rows those of the least rank stay.
    """
    words = [w for w in rules.FALLBACK_WORDS if w in text]
    rest = text.strip()
    for lead in rules.LEADING_QUESTION_WORDS:
        if rest.startswith(lead):
            rest = rest[len(lead):]
            break
    terms = words + ([rest.strip()] if rest.strip() else [])
    own = documents.filter(F.col("uploaded_by") == member)
    if not terms:
        return own.limit(0).withColumn("term", F.lit(None).cast("string"))
    hit = lambda w: _like("filename", w) | _like("display_name", w) | _like("raw_text", w)
    rank = F.coalesce(*[F.when(hit(w), F.lit(i)) for i, w in enumerate(terms)])
    top = own.withColumn("_rank", rank).filter(F.col("_rank").isNotNull()).orderBy("_rank", *_newest()).limit(limit)
    best = F.min("_rank").over(Window.partitionBy(F.lit(0)))  # over at most ``limit`` rows
    term = F.element_at(F.array(*[F.lit(w) for w in terms]), F.col("_rank") + 1)
    return top.withColumn("_best", best).filter(F.col("_rank") == F.col("_best")).orderBy(*_newest()).withColumn("term", term).drop("_rank", "_best")


def add_tag(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Q-21: add each target's tag (doc_id, tag) to its document; tags keep their order."""
    joined = documents.join(targets.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("_new")), "doc_id", "left")
    none = F.array().cast("array<string>")
    tags = F.when(F.col("_new").isNotNull(), merge_tags(F.coalesce("tags", none), F.col("_new"))).otherwise(F.col("tags"))
    return joined.withColumn("tags", tags).drop("_new")


def remove_tag(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Q-21: remove each target's tag; what remains is normalised."""
    joined = documents.join(targets.groupBy("doc_id").agg(F.collect_set(normalize_tag(F.col("tag"))).alias("_gone")), "doc_id", "left")
    none = F.array().cast("array<string>")
    tags = F.when(F.col("_gone").isNotNull(), F.array_except(merge_tags(F.coalesce("tags", none), none), F.col("_gone"))).otherwise(F.col("tags"))
    return joined.withColumn("tags", tags).drop("_gone")


def show_tags(documents: DataFrame) -> DataFrame:
    """Q-21."""
    none = F.array().cast("array<string>")
    return documents.select("doc_id", F.array_join(F.transform(merge_tags(F.coalesce("tags", none), none), lambda t: F.concat(F.lit("#"), t)), ", ").alias("shown"))


def search_by_type_word(documents: DataFrame, member: int, word: str) -> DataFrame:
    """Q-22: a localised plural ('invoices', ...) as the type filter."""
    return search_documents(documents, member, doc_type=rules.TYPE_WORDS.get(word.lower(), word.lower()))
