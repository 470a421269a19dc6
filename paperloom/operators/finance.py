"""Sums, balances, monthly reports, expiries and spikes over documents and transactions (Z-01 ... Z-05)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.skew import HOT_ROWS, lookup

MONEY = "decimal(38,2)"


# --- Z-01, Z-02: aggregates kept up to date ------------------------------------------------------


def type_year(day: Column) -> Column:
    return F.year(day).cast("long")


def sum_delta(before: DataFrame, after: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    """Z-01: what a change of rows does to sums and counts per ``keys``: old rows count against, new ones for it.

    ``before`` and ``after`` hold the changed rows only (an insert has no before, a delete no after).
    """
    signed = lambda df, sign: df.select(*keys, F.lit(sign).alias("_sign"), F.col(amount).cast(MONEY).alias("_amount"))
    both = signed(before, -1).unionByName(signed(after, 1))
    return both.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("_amount") * F.col("_sign")), F.lit(0)).cast(MONEY).alias("total"),
        F.coalesce(F.sum(F.when(F.col("_amount").isNotNull(), F.col("_sign"))), F.lit(0)).cast("long").alias("n_amounts"), F.sum("_sign").cast("long").alias("n"),
    )


def add_sums(sums: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Z-01: the sums after a change; groups without rows leave. Cost follows groups, not rows."""
    added = sums.unionByName(delta).groupBy(*keys).agg(F.sum("total").cast(MONEY).alias("total"), F.sum("n_amounts").alias("n_amounts"), F.sum("n").alias("n"))
    return added.filter(F.col("n") > 0)


def sums_of(rows: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    """Z-01: the full count."""
    return add_sums(sum_delta(rows.limit(0), rows, keys, amount), sum_delta(rows.limit(0), rows.limit(0), keys, amount), keys)


def latest_balances(rows: DataFrame, account: str = "account", order: tuple[str, str] = ("day", "doc_id")) -> DataFrame:
    """Z-02: the newest balance of each account; a partial aggregate."""
    row = F.struct(*order, "balance")
    return rows.filter(F.col(order[0]).isNotNull() & F.col("balance").isNotNull()).groupBy(account).agg(F.max_by(row, F.struct(*order)).alias("b")).select(account, "b.*")


def refresh_latest(latest: DataFrame, before: DataFrame, after: DataFrame, rows: DataFrame, account: str = "account", order: tuple[str, str] = ("day", "doc_id")) -> DataFrame:
    """Z-02: the newest balances after a change. New rows can only win; a row that is gone matters only where it was the newest:
    those accounts are counted again from ``rows`` (all rows after the change), no others are read from there.
    """
    gone = before.select(account, *order).join(latest.select(account, *order), [account, *order], "left_semi").select(account).distinct()
    kept = latest.join(gone, account, "left_anti")
    again = latest_balances(rows.join(gone, account, "left_semi"), account, order)
    columns = [account, *order, "balance"]
    new = after.select(*columns)
    return latest_balances(kept.select(*columns).unionByName(again.select(*columns)).unionByName(new), account, order)


# --- Z-03: monthly report ------------------------------------------------------------------------


def monthly_report(transactions: DataFrame, account: str = "account", day: str = "day", amount: str = "amount") -> DataFrame:
    """Z-03: (month, account, is_total, amount, previous, change, change_pct): every account from its first month to the last
    month of all, and a total row per month.

    One ``rollup`` gives accounts and totals. Months without a transaction are 0 and stand in a calendar made per account, so
    ``previous`` is always the month before. ``change_pct`` is NULL where that was 0.
    """
    monthly = transactions.filter(F.col(day).isNotNull() & F.col(amount).isNotNull()).select(
        F.trunc(day, "month").alias("month"), F.col(account).alias("account"), F.col(amount).cast(MONEY).alias("_amount")
    )
    sums = monthly.rollup("month", "account").agg(F.sum("_amount").cast(MONEY).alias("amount"), F.grouping_id().alias("_level")).filter(F.col("_level") < 3)
    sums = sums.select("month", F.when(F.col("_level") == 0, F.col("account")).alias("account"), (F.col("_level") == 1).alias("is_total"), "amount")
    last = monthly.agg(F.max("month").alias("last")).scalar()
    spans = sums.groupBy("account", "is_total").agg(F.min("month").alias("_first")).withColumn("_last", last)
    calendar = spans.select("account", "is_total", F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias("month"))
    held = sums.select(F.col("month").alias("_m"), F.col("account").alias("_a"), F.col("is_total").alias("_t"), "amount")
    filled = calendar.join(held, (F.col("month") == F.col("_m")) & F.col("account").eqNullSafe(F.col("_a")) & (F.col("is_total") == F.col("_t")), "left")
    own = filled.select("month", "account", "is_total", F.coalesce("amount", F.lit(0)).cast(MONEY).alias("amount"))
    before = F.lag("amount").over(Window.partitionBy("account", "is_total").orderBy("month"))
    report = own.withColumn("previous", before).withColumn("change", (F.col("amount") - F.col("previous")).cast(MONEY))
    share = F.when(F.col("previous") != 0, F.round(F.lit(100.0) * F.col("change").cast("double") / F.col("previous").cast("double"), 2))
    return report.withColumn("change_pct", share)


# --- Z-04: validity and expiry -------------------------------------------------------------------


def in_force(agreements: DataFrame, days: DataFrame, bin_days: int = 92) -> DataFrame:
    """Z-04: each agreement on each asked day on which it holds, with ``days_left`` (NULL without an end).

    ``agreements``: document_id, household, start_date, end_date (both may be NULL: open). ``days``: as_of, distinct. A range
    join by equality: an agreement stands in every bin of days that its interval touches (open ends reach to the first and
    last asked day), a day in one; only pairs of the same bin are compared, and each pair meets once.
    """
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    ends = days.agg(F.struct(F.min("as_of").alias("first"), F.max("as_of").alias("last")).alias("e")).scalar()
    spans = agreements.withColumn("_e", ends).filter(F.col("_e.first").isNotNull())
    low, high = F.greatest("start_date", F.col("_e.first")), F.least("end_date", F.col("_e.last"))
    binned = lambda d: F.floor(number(d) / bin_days)
    spans = spans.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= F.col("_high"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(binned(F.col("_low")), binned(F.col("_high"))))).drop("_e", "_low", "_high")
    asked = days.select("as_of", binned(F.col("as_of")).alias("_bin"))
    holds = (F.col("start_date").isNull() | (F.col("start_date") <= F.col("as_of"))) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("as_of")))
    return spans.join(asked, "_bin").filter(holds).drop("_bin").withColumn("days_left", F.datediff("end_date", "as_of"))


def expiring(agreements: DataFrame, days: DataFrame, within: int = 30) -> DataFrame:
    """Z-04: the agreements in force on a day that end within ``within`` days of it."""
    return in_force(agreements.filter(F.col("end_date").isNotNull()), days).filter(F.col("days_left") <= within)


def expiry_report(agreements: DataFrame, days: DataFrame, within: int = 30) -> DataFrame:
    """Z-04: per household and asked day: agreements in force, those that end soon, and the nearest end."""
    held = in_force(agreements, days)
    return held.groupBy("household", "as_of").agg(
        F.count(F.lit(1)).alias("n_in_force"), F.count_if(F.col("days_left") <= within).alias("n_expiring"), F.min("end_date").alias("next_end")
    )


# --- Z-05: spending spikes -----------------------------------------------------------------------


def spending_spikes(
    transactions: DataFrame, trailing_days: int = 90, factor: float = 3.0, least: int = 5, vendor: str = "vendor", day: str = "day", amount: str = "amount",
    row_id: str = "transaction_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Z-05: add ``n_before``, ``mean_before``, ``deviation_before`` (of the vendor's ``trailing_days`` before a transaction's day) and
    ``spike``: more than ``factor`` deviations above the mean of at least ``least`` transactions.

    Two levels: transactions fold to count, sum and sum of squares per vendor and day, by partial aggregates; the trailing
    frame runs over these, at most one row a day, so no vendor's transactions are sorted. The figures go back to the
    transactions by a join on vendor and day that spreads a hot day.
    """
    value = F.col(amount).cast("decimal(18,2)")
    daily = transactions.filter(F.col(vendor).isNotNull() & F.col(day).isNotNull()).groupBy(vendor, day).agg(
        F.count(value).alias("_n"), F.sum(value).cast(MONEY).alias("_s"), F.sum((value * value).cast("decimal(38,4)")).cast("decimal(38,4)").alias("_q"),
        F.count(F.lit(1)).alias("copies"),
    )
    number = F.datediff(day, F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(vendor).orderBy(number).rangeBetween(-trailing_days, -1)
    over = daily.select(
        vendor, day, "copies", F.coalesce(F.sum("_n").over(frame), F.lit(0)).alias("n_before"), F.sum("_s").over(frame).cast("double").alias("_sum"),
        F.sum("_q").over(frame).cast("double").alias("_squares"),
    )
    n, total = F.col("n_before"), F.col("_sum")
    variance = F.greatest(F.lit(0.0), (F.col("_squares") - total * total / n) / (n - 1))
    stats = over.select(
        vendor, day, "copies", "n_before", F.when(n > 0, total / n).alias("mean_before"), F.when(n > 1, F.sqrt(variance)).alias("deviation_before")
    )
    joined = lookup(transactions, stats, [vendor, day], "copies", row_id, hot_rows)
    high = F.col(amount).cast("double") > F.col("mean_before") + F.lit(factor) * F.col("deviation_before")
    return joined.withColumns({"n_before": F.coalesce("n_before", F.lit(0)), "spike": F.coalesce((F.col("n_before") >= least) & high, F.lit(False))})
