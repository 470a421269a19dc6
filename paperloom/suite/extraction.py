"""Fact extraction (F-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import extract as X
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, table

# where the date and the amount sit in the shape's text: "<phrase> <key> Date: dd/mm/yyyy Total: NIS <amount>"
_TEXT = """SELECT *, length(raw_text) - length(' Total: NIS ' || CAST(true_amount AS VARCHAR)) - 10 AS day_at,
  length(raw_text) - length('NIS ' || CAST(true_amount AS VARCHAR)) AS money_at FROM px_documents WHERE doc_id % 11 <> 0"""


@query(
    "f01_date_fact",
    f"""SELECT doc_id, strftime(true_date, '%d/%m/%Y') AS fact_value, 0.75::DOUBLE AS confidence,
      trim(substring(raw_text, greatest(day_at - 30, 0) + 1, day_at + 40 - greatest(day_at - 30, 0))) AS source_excerpt FROM ({_TEXT})
    UNION ALL SELECT doc_id, NULL, NULL, NULL FROM px_documents WHERE doc_id % 11 = 0""",
    ("documents",),
)
def f01(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", X.date_fact(F.col("raw_text")).alias("f"))
    return rows.select("doc_id", "f.fact_value", "f.confidence", "f.source_excerpt")


@query(
    "f01_date_fact_corpus",
    """SELECT doc_id, coalesce(
        nullif(regexp_extract(text, '(?:^|[^\\p{L}\\p{N}_])([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4})(?:$|[^\\p{L}\\p{N}_])', 1), ''),
        nullif(regexp_extract(text, '(?:^|[^\\p{L}\\p{N}_])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:$|[^\\p{L}\\p{N}_])', 1), '')) AS fact_value FROM documents""",
)
def f01_corpus(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.date_fact(F.col("text"))["fact_value"].alias("fact_value"))


@query(
    "f02_amount_facts",
    f"""SELECT doc_id, fact_key, CASE fact_key WHEN 'amount' THEN CAST(true_amount AS VARCHAR) ELSE 'ILS' END AS fact_value, 0.8::DOUBLE AS confidence,
      trim(substring(raw_text, greatest(money_at - 20, 0) + 1)) AS source_excerpt
    FROM ({_TEXT}), (VALUES ('amount'), ('currency')) k(fact_key)""",
    ("documents",),
)
def f02(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.explode(X.amount_facts(F.col("raw_text"))).alias("f"))
    return rows.select("doc_id", "f.*")


@query(
    "f03_remaining_keys",
    "SELECT doc_id, CASE doc_type "
    + " ".join(
        f"WHEN '{c}' THEN '{','.join(k for k in keys if k not in ('source_date', 'amount', 'currency'))}'" for c, keys in rules.CATEGORY_FACT_KEYS.items()
    )
    + " END AS keys FROM px_documents",
    ("documents",),
)
def f03(spark, sf):
    found = F.array(F.lit("source_date"), F.lit("amount"), F.lit("currency"))
    return load(spark, sf, "documents").select("doc_id", F.array_join(X.remaining_keys(F.col("doc_type"), found), ",").alias("keys"))


@query(
    "f04_extraction_plan",
    """WITH d AS (SELECT doc_id, text, list_value('contract', 'recipe', 'other', 'warranty')[1 + doc_id % 4] AS doc_type, (doc_id % 10)::DOUBLE / 10 AS q FROM documents),
      m AS (SELECT *, CASE WHEN q < 0.3 THEN 'regex_only' WHEN doc_type = 'recipe' THEN 'recipe' WHEN length(text) > 4000 THEN 'chunked' ELSE 'single' END AS mode FROM d)
    SELECT mode, doc_type, keys, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(chars) AS BIGINT) AS chars FROM (
      SELECT mode, doc_type, CASE mode WHEN 'regex_only' THEN 0 WHEN 'recipe' THEN 5 ELSE CASE doc_type WHEN 'contract' THEN 14 WHEN 'other' THEN 3 ELSE 2 END END AS keys,
        CASE mode WHEN 'regex_only' THEN 0 WHEN 'chunked' THEN length(substring(text, i * 2700 + 1, 3000)) ELSE length(text) END AS chars
      FROM (SELECT *, unnest(range(0, CASE WHEN mode = 'chunked' THEN CAST(ceil(length(text) / 2700.0) AS BIGINT) ELSE 1 END)) AS i FROM m)) GROUP BY ALL""",
)
def f04(spark, sf):
    types = F.array(*[F.lit(t) for t in ("contract", "recipe", "other", "warranty")])
    docs = table(spark, sf, "documents").select(
        "doc_id", F.element_at(types, (F.col("doc_id") % 4 + 1).cast("int")).alias("doc_type"), F.col("text").alias("raw_text"),
        ((F.col("doc_id") % 10).cast("double") / 10).alias("text_quality"), F.array(F.lit("source_date")).alias("found_keys"),
    )
    plan = X.extraction_plan(docs).join(docs.select("doc_id", "doc_type"), "doc_id")
    return plan.groupBy("mode", "doc_type", F.size("keys").alias("keys")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.coalesce(F.length("chunk"), F.lit(0))).cast("long").alias("chars")
    )


def _answers(spark, sf):
    """Facts as model answers, one JSON list per document and chunk (line number); some answers are cut off."""
    facts = load(spark, sf, "facts").withColumn("chunk_id", F.floor(F.col("fact_seq") / 10_000_000_000_000))
    item = F.struct("fact_seq", F.struct("fact_key", "fact_value", "confidence", "source_excerpt").alias("item"))
    packed = facts.groupBy("document_id", "fact_type", "chunk_id").agg(F.array_sort(F.collect_list(item))["item"].alias("items"))
    good = F.concat(F.lit("Facts:\n"), F.to_json("items"), F.lit("\nend"))
    bad = F.lit('[{"fact_key": "amount", "fact_va]')
    return packed.select(
        "document_id", "fact_type", "chunk_id",
        F.when(F.col("document_id") % 7 == 0, bad).when(F.col("document_id") % 7 == 1, F.lit("none found")).otherwise(good).alias("answer"),
    )


_KEYS = ", ".join(f"'{k}'" for k in rules.FACT_KEYS)
_USABLE = f"SELECT * FROM px_facts WHERE document_id % 7 > 1 AND fact_value <> '' AND fact_key IN ({_KEYS})"


@query(
    "f05_answer_facts",
    f"""SELECT document_id, fact_key, fact_type, fact_value, confidence, source_excerpt FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, fact_key ORDER BY fact_seq) AS rn FROM ({_USABLE}))
    WHERE rn = 1 AND NOT (document_id % 3 = 0 AND fact_key IN ('amount', 'currency'))""",
    ("facts",),
)
def f05(spark, sf):
    found = load(spark, sf, "documents").filter(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit("amount"), F.lit("currency"))).alias("fact_key")
    )
    return X.single_answer_facts(X.answer_items(_answers(spark, sf)), found).select(
        "document_id", "fact_key", "fact_type", "fact_value", "confidence", "source_excerpt"
    )


_MERGE_KEYS = ["obligations", "parties", "amount", "counterparty"]


@query(
    "f06_merge_chunk_facts",
    """WITH f AS (SELECT document_id, fact_seq, fact_type, list_value('obligations', 'parties', 'amount', 'counterparty')[1 + fact_seq // 100000 % 4] AS fact_key,
        'v' || (fact_seq % 100000 % 3) AS fact_value, confidence, source_excerpt FROM px_facts),
      s AS (SELECT *, row_number() OVER (PARTITION BY document_id, fact_key ORDER BY confidence DESC, fact_seq) AS rn FROM f WHERE fact_key IN ('amount', 'counterparty')),
      v AS (SELECT document_id, fact_key, fact_value, min(fact_seq) AS seq, min_by(confidence, fact_seq) AS confidence, min_by(source_excerpt, fact_seq) AS source_excerpt
            FROM f WHERE fact_key IN ('obligations', 'parties') GROUP BY ALL)
    SELECT document_id, fact_key, fact_value, confidence, source_excerpt FROM s WHERE rn = 1
    UNION ALL SELECT document_id, fact_key, string_agg(fact_value, '; ' ORDER BY seq), max(confidence), min_by(source_excerpt, seq) FROM v GROUP BY ALL""",
    ("facts",),
)
def f06(spark, sf):
    keys = F.array(*[F.lit(k) for k in _MERGE_KEYS])
    seq = F.col("fact_seq")
    items = load(spark, sf, "facts").withColumns(
        {
            "fact_key": F.element_at(keys, (F.floor(seq / 100_000) % 4 + 1).cast("int")),
            "fact_value": F.concat(F.lit(" v"), (seq % 100_000 % 3).cast("string")),
        }
    )
    return X.merge_chunk_facts(items).select("document_id", "fact_key", "fact_value", "confidence", "source_excerpt")


def _recipe_answers(spark, sf):
    """Recipes per document, one per line item; odd fields are missing or blank."""
    c = F.col
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", (c("l_linenumber").cast("long") * 100_000_000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("seq"),
        F.struct(
            F.when(c("l_partkey") % 6 != 0, F.concat(F.lit(" Dish "), c("l_partkey").cast("string"))).alias("recipe_name"),
            F.concat(F.lit("flour "), c("l_suppkey").cast("string")).alias("ingredients"),
            F.when(c("l_partkey") % 4 == 0, F.lit("  ")).otherwise(F.lit("mix\nbake")).alias("instructions"),
            F.when(c("l_suppkey") % 2 == 0, F.floor(c("l_quantity"))).alias("servings"),
        ).alias("recipe"),
    )
    packed = li.groupBy(c("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "recipe")))["recipe"].alias("r"))
    return packed.select("document_id", F.when(c("document_id") % 9 == 0, F.lit("sorry [")).otherwise(F.concat(F.lit("ok "), F.to_json("r"))).alias("answer"))


@query(
    "f07_recipe_facts",
    """WITH r AS (SELECT l_orderkey AS document_id, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem WHERE l_orderkey % 9 <> 0),
      named AS (SELECT *, CASE WHEN n > 1 THEN 'Dish ' || p ELSE '' END AS source_excerpt FROM r WHERE p % 6 <> 0)
    SELECT document_id, 'recipe_name' AS fact_key, 'Dish ' || p AS fact_value, 0.7::DOUBLE AS confidence, source_excerpt FROM named
    UNION ALL SELECT document_id, 'ingredients', 'flour ' || s, 0.7::DOUBLE, source_excerpt FROM named
    UNION ALL SELECT document_id, 'instructions', 'mix' || chr(10) || 'bake', 0.7::DOUBLE, source_excerpt FROM named WHERE p % 4 <> 0
    UNION ALL SELECT document_id, 'servings', CAST(CAST(floor(q) AS BIGINT) AS VARCHAR), 0.6::DOUBLE, source_excerpt FROM named WHERE s % 2 = 0""",
)
def f07(spark, sf):
    return X.recipe_facts(_recipe_answers(spark, sf)).select("document_id", "fact_key", "fact_value", "confidence", "source_excerpt")


# what the shape's first and second answer hold: valid, confidence, has net salary
_PASSES = """SELECT *, doc_id % 7 > 1 AS v1, CASE doc_id % 7 WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS c1, doc_id % 7 <> 3 AS n1,
    doc_id % 5 <> 0 AS v2, CASE WHEN doc_id % 5 = 1 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS c2, doc_id % 5 = 1 AS n2 FROM px_slips"""
_CHOICE = f"""SELECT *, CASE WHEN s1 THEN 1 WHEN v2 AND (s2 OR c2 >= CASE WHEN v1 THEN c1 ELSE 0 END) THEN 2 ELSE 1 END AS pass FROM (
    SELECT *, v1 AND c1 >= 0.6 AND n1 AS s1, v2 AND c2 >= 0.6 AND n2 AS s2 FROM ({_PASSES}))"""
CHOSEN = f"""SELECT *, CASE pass WHEN 1 THEN v1 ELSE v2 END AS valid, CASE pass WHEN 1 THEN c1 ELSE c2 END AS conf, CASE pass WHEN 1 THEN n1 ELSE n2 END AS has_net FROM ({_CHOICE})"""


def chosen_payloads(spark, sf):
    slips = load(spark, sf, "slips")
    picked = slips.withColumn("best", X.better_payload(X.salary_payload(F.col("first_answer")), X.salary_payload(F.col("second_answer"))))
    return picked.withColumns({"payload": F.col("best.payload"), "model": F.col("best.model")}).drop("best")


@query(
    "f08_salary_payload",
    f"""SELECT doc_id, CASE WHEN v1 THEN true_employee END AS employee_name, CASE WHEN v1 THEN true_pay_month END AS pay_month, CASE WHEN v1 THEN true_gross END AS gross_salary,
      CASE WHEN v1 AND n1 THEN true_net END AS net_salary, CASE WHEN v1 THEN true_tax END AS income_tax, CAST(NULL AS DOUBLE) AS health_tax, CASE WHEN v1 THEN c1 END AS confidence FROM ({_PASSES})""",
    ("slips",),
)
def f08(spark, sf):
    rows = load(spark, sf, "slips").select("doc_id", X.salary_payload(F.col("first_answer")).alias("p"))
    return rows.select("doc_id", *[F.col(f"p.{k}").alias(k) for k in ["employee_name", "pay_month", "gross_salary", "net_salary", "income_tax", "health_tax", "confidence"]])


@query(
    "f09_better_payload",
    f"SELECT doc_id, s1 AS strong, CASE pass WHEN 1 THEN 'haiku_text' ELSE 'sonnet_text' END AS model, CASE WHEN valid THEN conf END AS confidence FROM ({CHOSEN})",
    ("slips",),
)
def f09(spark, sf):
    rows = chosen_payloads(spark, sf)
    return rows.select("doc_id", X.strong_enough(X.salary_payload(F.col("first_answer"))).alias("strong"), "model", F.col("payload.confidence").alias("confidence"))


_NUM = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) || '.0' ELSE rtrim(CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR), '0') END"


@query(
    "f10_payload_facts",
    f"""WITH c AS (SELECT * FROM ({CHOSEN}) WHERE valid)
    SELECT doc_id AS document_id, 'employee_name' AS fact_key, true_employee AS fact_value, conf AS confidence FROM c
    UNION ALL SELECT doc_id, 'employer_name', true_employer, conf FROM c
    UNION ALL SELECT doc_id, 'pay_month', true_pay_month, conf FROM c
    UNION ALL SELECT doc_id, 'gross_salary', {_NUM('true_gross')}, conf FROM c
    UNION ALL SELECT doc_id, 'net_salary', {_NUM('true_net')}, conf FROM c WHERE has_net
    UNION ALL SELECT doc_id, 'income_tax', {_NUM('true_tax')}, conf FROM c""",
    ("slips",),
)
def f10(spark, sf):
    return X.payload_facts(chosen_payloads(spark, sf)).select("document_id", "fact_key", "fact_value", "confidence")


@query(
    "f10_payload_metadata",
    f"SELECT doc_id, CASE WHEN valid THEN 'v1' END AS version, CASE WHEN valid THEN CAST(conf AS VARCHAR) END AS gross_confidence FROM ({CHOSEN})",
    ("slips",),
)
def f10_metadata(spark, sf):
    rows = chosen_payloads(spark, sf).select("doc_id", X.payload_metadata(F.col("payload"), F.col("model")).alias("m"))
    return rows.select("doc_id", F.get_json_object("m", "$.extraction_version").alias("version"), F.get_json_object("m", "$.field_confidence.gross_salary").alias("gross_confidence"))


@query(
    "f11_memory_items",
    """SELECT member_id, content, CASE WHEN memory_id % 2 = 0 THEN category ELSE 'context' END AS category, CASE WHEN memory_id % 3 = 0 THEN memory_type ELSE 'short' END AS memory_type,
      CASE WHEN memory_id % 5 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM px_memories WHERE memory_id % 7 <> 0 AND memory_id % 11 <> 0""",
    ("memories",),
)
def f11(spark, sf):
    c = F.col
    k = c("memory_id")
    item = F.struct(
        F.when(k % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), c("content"))).alias("content"), F.when(k % 2 == 0, c("category")).alias("category"),
        F.when(k % 3 == 0, c("memory_type")).alias("memory_type"), F.when(k % 5 == 0, F.lit(0.25)).alias("confidence"),
    )
    answers = load(spark, sf, "memories").select("member_id", F.when(k % 7 == 0, F.to_json(item)).otherwise(F.to_json(F.array(item))).alias("answer"))
    return X.memory_items(answers).drop("item_no")


@query(
    "f12_fact_rows",
    f"""SELECT doc_id AS document_id, pos AS fact_seq, doc_type AS fact_type, key AS fact_key,
      CASE key WHEN 'source_date' THEN strftime(true_date, '%d/%m/%Y') WHEN 'amount' THEN CAST(true_amount AS VARCHAR) ELSE 'ILS' END AS fact_value,
      CASE key WHEN 'source_date' THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END AS confidence
    FROM (SELECT * FROM px_documents WHERE doc_id % 11 <> 0), (VALUES (0::BIGINT, 'source_date'), (1::BIGINT, 'amount'), (2::BIGINT, 'currency')) k(pos, key)""",
    ("documents",),
)
def f12(spark, sf):
    docs = load(spark, sf, "documents").withColumn("facts", X.regex_facts(F.col("raw_text")))
    return X.fact_rows(docs).drop("source_excerpt")
