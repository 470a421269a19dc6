"""Document fingerprints in DataFrame operations only: weighted SimHash and a search within a Hamming radius.

Fingerprint: terms are runs of ``SIZE`` words (a shorter text is one term), hashed to 64 bits; each vote weighs the bytes
of its words, so runs of long words count for more, and a term votes as often as it occurs. Bits are counted two to a
long (bits k and k + 32), so a text is 32 sums and a total, added up before any shuffle. A bit is set by more than half
of the weight; no words give zero. The likeness of two fingerprints is the share of equal bits.

Search: the 64 bits fall into ``BLOCKS`` blocks; fingerprints within ``RADIUS`` bits agree on at least BLOCKS - RADIUS of
them. There is one table per choice of that many blocks, keyed by their bits put together (the permutation that brings
them to the front). A query looks up its key in each table and checks the members found; a pair is counted in the first
table that holds it. Members of a key are stored in packed rows of ``PACK`` at most, so a key with very many members is
several rows, in several tasks, and no row is made per pair.

Next document: ids are cut into ranges at their quantiles; each range also gets the first row of the range after it, so
that the following row is found inside a range and each text is shuffled once.

Null text is empty. Order is by descending doc_id, null last, then by text hash. Repeated rows follow each other. Only
doc_id and text are read.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.frames import documents
from paperloom.session import cut_lineage

SIZE = 3
RADIUS = 3
BLOCKS = 5
PACK = 1024
SEPARATORS = "[\\x20\\x09-\\x0D]+"
_PAIR = (1 << 32) + 1
_LEAST = -(1 << 63)


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def simhash(texts: DataFrame, keys: list[str], text: str, name: str, size: int = SIZE) -> DataFrame:
    """``keys`` and the fingerprint ``name`` of ``text``, one row per distinct value of ``keys``.

    Rows that are equal in ``keys`` must have equal texts; their votes add up, which leaves the fingerprint as it is.
    """
    words = texts.select(*keys, F.split(F.trim(F.regexp_replace(text, SEPARATORS, " ")), " ").alias("__w"))
    count = F.greatest(F.size("__w") - (size - 1), F.lit(1))
    runs = words.select(*keys, F.inline_outer(F.arrays_zip(*[F.slice("__w", k + 1, count).alias(f"w{k}") for k in range(size)])))
    parts = [F.col(f"w{k}") for k in range(size)]
    weight = sum((F.coalesce(F.octet_length(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.octet_length(parts[0]), F.lit(0))).cast("long")
    hashed = runs.select(*keys, F.xxhash64(*parts).alias("__h"), weight.alias("__n"))
    both = [F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(_PAIR)) * F.col("__n")).alias(f"__b{k}") for k in range(32)]
    sums = hashed.groupBy(*keys).agg(F.sum("__n").alias("__n"), *both)
    votes = lambda k: F.shiftrightunsigned(f"__b{k - 32}", 32) if k >= 32 else F.col(f"__b{k}").bitwiseAND(F.lit((1 << 32) - 1))
    total = F.lit(0).cast("long")
    for k in range(64):
        total = total.bitwiseOR(F.when(2 * votes(k) > F.col("__n"), F.lit(1 << k if k < 63 else _LEAST).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, total.alias(name))


def _range(value: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` are greater than ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    array = F.lit(bounds)
    go = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) > value), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), go)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text, h, next_id, next_h, next_text): the following row by descending doc_id, at the end the first."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": F.coalesce("doc_id", F.lit(_LEAST)), "h": F.xxhash64("text")})
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n)) if n > 1 else F.lit(None)
    bounds = sorted(set(docs.agg(marks.alias("b")).first()["b"] or []), reverse=True)
    placed = rows.withColumn("bucket", _range(F.col("key"), bounds))
    heads = placed.groupBy("bucket").agg(F.max("key").alias("key"))
    order = Window.orderBy("bucket")  # over one row per range
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = heads.select("key", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(ends)).alias("before"))
    before = cut_lineage(before, "range-heads")
    guests = placed.join(before, "key").select("doc_id", "text", "key", "h", F.col("before").alias("bucket"))
    both = placed.select(*guests.columns, F.lit(0).alias("guest")).unionAll(guests.withColumn("guest", F.lit(1)))
    inside = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "h")
    following = both.withColumns(
        {"place": F.row_number().over(inside), "next_id": F.lead("doc_id").over(inside), "next_h": F.lead("h").over(inside), "next_text": F.lead("text").over(inside)}
    )
    return following.where("guest = 0").drop("guest", "key")


def table_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> tuple[Column, list[int]]:
    """An array of (table, key) of a fingerprint, and each table's mask of the bits in its key."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(t).alias("table"), fingerprint.bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)]), signed


def count_near(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pack: int = PACK) -> DataFrame:
    """(fingerprint, n_near): for each of ``queries`` how many other values of ``stored`` (both distinct) lie within the radius."""
    keys, masks = table_keys(F.col("fingerprint"), radius, blocks)
    entries = stored.select("fingerprint", F.inline(keys))
    large = cut_lineage(entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > pack), "large-keys")
    salted = entries.join(large, ["table", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.ceil(F.coalesce("n", F.lit(1)) / pack)))
    packed = salted.groupBy("table", "key", "salt").agg(F.collect_list("fingerprint").alias("members"))
    asked = queries.select(F.col("fingerprint").alias("q"), F.inline(keys))
    earlier = F.slice(F.lit(masks), 1, F.col("table"))
    near = lambda m: (
        (m != F.col("q")) & (F.bit_count(m.bitwiseXOR(F.col("q"))) <= radius) & F.forall(earlier, lambda mask: m.bitwiseXOR(F.col("q")).bitwiseAND(mask) != 0)
    )
    counted = asked.join(packed, ["table", "key"]).select("q", F.size(F.filter("members", near)).alias("n"))
    found = counted.groupBy("q").agg(F.sum("n").alias("n"))
    return queries.join(found, F.col("fingerprint") == F.col("q"), "left").select("fingerprint", F.coalesce("n", F.lit(0)).cast("long").alias("n_near"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fingerprint) of the distinct texts of each doc_id; h is the text's hash."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return simhash(rows, ["doc_id", "h"], "text", "fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its key, length, next document, and the hash and fingerprint of its edited text."""
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    found = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    text = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substring("next_text", F.lit(1), tail))
    rows = found.select("bucket", "place", "doc_id", "h", "n_chars", "next_id", "next_h", text.alias("edited"))
    hashed = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    return simhash(hashed, ["bucket", "place", "doc_id", "h", "n_chars", "next_id", "next_h", "edited_sha256"], "edited", "edited_fingerprint")


def compared(docs: DataFrame) -> DataFrame:
    """The fingerprint of each row of ``docs`` (doc_id, text), of its edited text, and how like it the edited and the next are."""
    stored = cut_lineage(fingerprints(docs), "fingerprints")
    rows = cut_lineage(edited(docs), "edited")
    own = stored.select(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h"), "fingerprint")
    following = stored.select(F.col("doc_id").alias("b_id"), F.col("h").alias("b_h"), F.col("fingerprint").alias("next_fingerprint"))
    joined = rows.join(own, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))).join(
        following, F.col("next_id").eqNullSafe(F.col("b_id")) & (F.col("next_h") == F.col("b_h"))
    )
    asked = stored.where(F.col("doc_id") % 20 == 0).select("fingerprint").distinct()
    near = cut_lineage(count_near(asked, stored.select("fingerprint").distinct()), "near")
    counted = joined.join(near.withColumnRenamed("fingerprint", "near_to"), (F.col("fingerprint") == F.col("near_to")) & (F.col("doc_id") % 20 == 0), "left")
    return counted.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "n_near",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``, for every twentieth id: the other fingerprints of the table within the radius."""
    spelt = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0").alias(c)
    found = compared(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", spelt("fingerprint"), spelt("edited_fingerprint"), "near_edited", "near_next", "n_near")
