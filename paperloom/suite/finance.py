"""Sums, balances, reports, expiries and spikes (Z-01 ... Z-05)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import finance as Z
from paperloom.suite.registry import query
from paperloom.suite.shapes import load, table

# A third of the documents come in a change: some are new, some are revised (another type and amount), some are deleted.
_AFTER = """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'invoice' ELSE doc_type END AS doc_type, CASE WHEN doc_id % 10 = 3 THEN amount * 2 ELSE amount END AS amount, doc_date, uploaded_by
    FROM px_documents WHERE doc_id % 10 <> 5"""


def _change(spark, sf):
    """Rows before a change, the changed rows as they were and as they are, and all rows after it."""
    docs = load(spark, sf, "documents").select("doc_id", "doc_type", F.col("amount").cast(Z.MONEY).alias("amount"), "doc_date", "uploaded_by")
    k = F.col("doc_id") % 10
    held = docs.filter(k != 7)
    revised = docs.filter(k == 3).withColumns({"doc_type": F.lit("invoice"), "amount": (F.col("amount") * 2).cast(Z.MONEY)})
    before, after = docs.filter(k.isin(3, 5)), revised.unionByName(docs.filter(k == 7))
    return held, before, after, docs.filter(~k.isin(3, 5)).unionByName(revised)


@query(
    "z01_type_year_sums",
    f"SELECT doc_type, year(doc_date)::BIGINT AS year, coalesce(sum(amount), 0)::DOUBLE AS total, count(amount) AS n_amounts, count(*) AS n FROM ({_AFTER}) GROUP BY ALL",
    ("documents",),
)
def z01(spark, sf):
    keys = ["doc_type", "year"]
    held, before, after, _ = [df.withColumn("year", Z.type_year(F.col("doc_date"))) for df in _change(spark, sf)]
    sums = Z.add_sums(Z.sums_of(held, keys), Z.sum_delta(before, after, keys), keys)
    return sums.select(*keys, F.col("total").cast("double").alias("total"), "n_amounts", "n")


@query(
    "z02_latest_balances",
    f"""SELECT uploaded_by AS account, max(doc_date) AS day, max_by(doc_id, (doc_date, doc_id)) AS doc_id, max_by(amount, (doc_date, doc_id))::DOUBLE AS balance
    FROM ({_AFTER}) WHERE amount IS NOT NULL AND doc_date IS NOT NULL GROUP BY 1""",
    ("documents",),
)
def z02(spark, sf):
    shape = lambda df: df.select(F.col("uploaded_by").alias("account"), F.col("doc_date").alias("day"), "doc_id", F.col("amount").alias("balance"))
    held, before, after, everything = map(shape, _change(spark, sf))
    return Z.refresh_latest(Z.latest_balances(held), before, after, everything).withColumn("balance", F.col("balance").cast("double"))


@query(
    "z03_monthly_report",
    """WITH t AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, 'account ' || (o_custkey % 300) AS account, o_totalprice::DECIMAL(18,2) AS amount FROM orders),
      s AS (SELECT month, account, false AS is_total, sum(amount) AS amount FROM t GROUP BY ALL UNION ALL SELECT month, NULL, true, sum(amount) FROM t GROUP BY month),
      c AS (SELECT account, is_total, unnest(generate_series(min(month), (SELECT max(month) FROM t), INTERVAL 1 MONTH))::DATE AS month FROM s GROUP BY account, is_total),
      f AS (SELECT c.month, c.account, c.is_total, coalesce(s.amount, 0) AS amount FROM c LEFT JOIN s ON s.month = c.month AND s.account IS NOT DISTINCT FROM c.account AND s.is_total = c.is_total),
      l AS (SELECT *, lag(amount) OVER (PARTITION BY account, is_total ORDER BY month) AS previous FROM f)
    SELECT month, account, is_total, amount::DOUBLE AS amount, previous::DOUBLE AS previous, (amount - previous)::DOUBLE AS change,
      CASE WHEN previous <> 0 THEN round(100.0::DOUBLE * (amount - previous)::DOUBLE / previous::DOUBLE, 2) END AS change_pct FROM l""",
)
def z03(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("account "), (F.col("o_custkey") % 300).cast("string")).alias("account"), F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )
    number = lambda c: F.col(c).cast("double").alias(c)
    return Z.monthly_report(orders).select("month", "account", "is_total", number("amount"), number("previous"), number("change"), "change_pct")


_AGREEMENTS = """SELECT o_orderkey AS document_id, o_custkey % 200 AS household, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS start_date,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + (20 + o_custkey % 900)::INTEGER END AS end_date FROM orders"""
_DAYS = "SELECT unnest(generate_series(DATE '1995-01-01', DATE '1997-12-01', INTERVAL 1 MONTH))::DATE AS as_of"


def _agreements(spark, sf):
    """Orders as contracts and policies, some without a start, some without an end, and the first days of 36 months."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(
        k.alias("document_id"), (F.col("o_custkey") % 200).alias("household"), F.when(k % 9 != 0, day).alias("start_date"),
        F.when(k % 5 != 0, F.date_add(day, (20 + F.col("o_custkey") % 900).cast("int"))).alias("end_date"),
    )
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("1997-12-01").cast("date"), F.expr("interval 1 month"))).alias("as_of"))
    return rows, days


@query(
    "z04_expiring",
    f"""SELECT document_id, as_of, (end_date - as_of)::INTEGER AS days_left FROM ({_AGREEMENTS}) JOIN ({_DAYS}) ON (start_date IS NULL OR start_date <= as_of)
      AND end_date BETWEEN as_of AND as_of + 30""",
)
def z04(spark, sf):
    return Z.expiring(*_agreements(spark, sf)).select("document_id", "as_of", "days_left")


@query(
    "z04_expiry_report",
    f"""SELECT household, as_of, count(*) AS n_in_force, count(*) FILTER (end_date <= as_of + 30) AS n_expiring, min(end_date) AS next_end
    FROM ({_AGREEMENTS}) JOIN ({_DAYS}) ON (start_date IS NULL OR start_date <= as_of) AND (end_date IS NULL OR end_date >= as_of) GROUP BY ALL""",
)
def z04_report(spark, sf):
    return Z.expiry_report(*_agreements(spark, sf))


@query(
    "z05_spending_spikes",
    """WITH t AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS transaction_id, l_suppkey % 20 AS vendor, l_shipdate::DATE AS day, l_extendedprice::DECIMAL(18,2) AS amount FROM lineitem),
      w AS (SELECT *, count(amount) OVER f AS n, sum(amount) OVER f AS s, sum((amount * amount)::DECIMAL(38,4)) OVER f AS q FROM t
        WINDOW f AS (PARTITION BY vendor ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT transaction_id, n AS n_before, floor(CASE WHEN n > 0 THEN s::DOUBLE / n END)::BIGINT AS mean_before,
      coalesce(n >= 5 AND amount::DOUBLE > s::DOUBLE / n + 2.0 * sqrt(greatest(0.0, (q::DOUBLE - s::DOUBLE * s::DOUBLE / n) / (n - 1))), false) AS spike FROM w""",
)
def z05(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").select(
        ((c("l_orderkey") * 10 + c("l_linenumber")) * 100_000 + c("l_suppkey")).alias("transaction_id"), (c("l_suppkey") % 20).alias("vendor"), F.to_date("l_shipdate").alias("day"),
        c("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    # a low limit sends busy days through the path for hot keys
    spikes = Z.spending_spikes(rows, factor=2.0, hot_rows=4)
    return spikes.select("transaction_id", "n_before", F.floor("mean_before").alias("mean_before"), "spike")
