"""Many text rules against many texts (P-01, C-01).

A keyword rule holds where its text occurs in the folded content; a regex rule can only hold where the literal text that
every match must contain occurs. So a rule is filed under one piece of that literal, as long as the literal allows (``WIDTHS``)
and the one that the fewest rules share, and a text is compared only with the rules filed under one of its own pieces: an
equality join finds the candidates, the full check decides. Four letters alone would not do: a million numbers share ten
thousand such pieces, and the candidates of a text would grow with the rules. Rules without such a literal are checked against
every text, in arrays of bounded size.

No array holds all rules, and no pair of text and rule is made without a shared piece,
but for the rules that have none. The filed pieces set bits in a Bloom filter of bounded size, and only those pieces of a text that
it lets through leave the task that reads the text: a text has a hundred pieces and hardly any of them is filed. Exploded sides
are joined by shuffles: their size is estimated from the table before the explode, and such a broadcast would fill the driver.
"""
from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.regex import first_match, let, required_literal
from paperloom.session import cut_lineage

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[required_literal.__module__])

WIDTHS = (4, 6, 8, 12)  # lengths of pieces; a literal has pieces of the largest that it holds
SALT = 32  # parts of the texts that meet the rules without a literal
LOOSE = 500  # rules without a literal that are checked together
SHORT = 200  # letters of a text that goes along with its pieces; a longer one is looked up
FILTER_WORDS = (1 << 6, 1 << 20)  # least and most 64-bit words of the filter over filed pieces
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(StringType())
def _literals(pattern: pd.Series) -> pd.Series:
    """Runs over the rule table only. ``pattern``: as its writer spelled it."""
    return pattern.map(required_literal)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _cut(letters: Column, width: int) -> Column:
    starts = F.slice(letters, 1, F.greatest(F.size(letters) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.concat(x, *[F.element_at(letters, (i + 1 + k).cast("int")) for k in range(1, width)]))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def literal_pieces(text: Column) -> Column:
    """The distinct pieces of a literal, of the largest width that it holds."""
    none = F.array().cast("array<string>")
    cut = lambda c: first_match([(F.size(c) >= w, _cut(c, w)) for w in reversed(WIDTHS)], none)
    return F.when(F.length(text) >= WIDTHS[0], F.array_distinct(let(_letters(text), cut))).otherwise(none)


def pieces(text: Column, widths: Column | None = None) -> Column:
    """The distinct pieces of a text, of the widths that rules are filed under (an array; the least width alone by default)."""
    widths = F.array(F.lit(WIDTHS[0])) if widths is None else widths
    none = F.array().cast("array<string>")
    cut = lambda c: F.concat(*[F.when(F.array_contains(widths, w), _cut(c, w)).otherwise(none) for w in WIDTHS])
    return F.when(F.length(text) >= WIDTHS[0], F.array_distinct(let(_letters(text), cut))).otherwise(none)


def file_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules under their piece, and those without one. ``rules``: scope, pattern, exclusion_type, written (regex as its writer spelled it)."""
    literal = F.when(F.col("exclusion_type") == "keyword", F.col("pattern")).otherwise(_ascii_lower(_literals(F.col("written"))))
    marked = rules.dropDuplicates(["scope", "pattern", "exclusion_type"]).withColumn("_pieces", literal_pieces(literal))
    plain = cut_lineage(marked.select("scope", "pattern", "exclusion_type", "_pieces"), "rules")  # literals are read once, by Python
    loose = plain.filter(F.size("_pieces") == 0).drop("_pieces")
    spread = plain.filter(F.size("_pieces") > 0).select("scope", "pattern", "exclusion_type", F.explode("_pieces").alias("piece"))
    shared = spread.groupBy("piece").agg(F.count(F.lit(1)).alias("_shared"))
    best = spread.join(shared.hint("merge"), "piece").groupBy("scope", "pattern", "exclusion_type").agg(F.min_by("piece", F.struct("_shared", "piece")).alias("piece"))
    return cut_lineage(best, "filed-rules"), loose


def _place(scope: Column, piece: Column, words: int) -> tuple[Column, Column]:
    """A filed piece's word in the filter (from 1), and the four bits that it sets there."""
    hashed = F.xxhash64(scope, piece)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    bits = one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))
    return hashed.bitwiseAND(F.lit(words - 1)).cast("int") + 1, bits


def _filter_words(filed: DataFrame, words: int) -> Column:
    """All words of the filter over ``filed`` (_scope, piece), as one array."""
    word, bits = _place(F.col("_scope"), F.col("piece"), words)
    every = filed.sparkSession.range(1, words + 1).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    held = filed.select(word.alias("_word"), bits.alias("_bits")).unionByName(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return held.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"]).alias("w")).scalar()


def holds(content: Column, pattern: Column, kind: Column) -> Column:
    return F.when(kind == "keyword", F.contains(F.lower(content), pattern)).otherwise(F.rlike(content, pattern))


def matched(texts: DataFrame, rules: DataFrame, loose_rules: int = LOOSE) -> DataFrame:
    """The digests of the texts that a rule of their scope or a rule for everyone (scope NULL) matches, each once.

    ``texts``: scope, digest, content; the digest stands for scope and content. ``rules``: scope, pattern (Java's spelling), written,
    exclusion_type.
    """
    filed, loose = file_rules(rules)
    everyone, own = F.lit("*"), F.concat(F.lit("="), F.col("scope").cast("string"))
    scope = F.coalesce(own, everyone)
    scoped = F.count_if(F.col("scope").isNotNull()).alias("own")
    # a few numbers: how many rules, and the widths that their pieces have
    n_filed, n_loose = filed.agg(F.count(F.lit(1)).alias("all"), scoped, F.collect_set(F.length("piece")).alias("widths")).first(), loose.agg(F.count(F.lit(1)).alias("all"), scoped).first()
    asking = lambda n: F.explode(F.array_compact(F.array(*[everyone] * (n["all"] > n["own"]), *[own] * (n["own"] > 0))))
    hits = []
    if n_filed["all"]:
        widths = F.array(*[F.lit(w) for w in sorted(n_filed["widths"])])
        lowered, spelled = F.lower("content"), _ascii_lower(F.col("content"))
        found = F.when(lowered == spelled, pieces(lowered, widths)).otherwise(F.array_union(pieces(lowered, widths), pieces(spelled, widths)))
        filed = filed.select(scope.alias("_scope"), "piece", "pattern", "exclusion_type")
        words = min(max(1 << (n_filed["all"] // 4).bit_length(), FILTER_WORDS[0]), FILTER_WORDS[1])
        word, bits = _place(F.col("_scope"), F.col("piece"), words)
        short = F.length("content") <= SHORT
        asked = texts.select("scope", "digest", F.when(short, F.col("content")).alias("content"), F.explode(found).alias("piece")).withColumn("_scope", asking(n_filed)).drop("scope")
        asked = asked.filter(F.element_at(_filter_words(filed, words), word).bitwiseAND(bits) == bits)
        candidates = asked.join(filed.hint("merge"), ["piece", "_scope"])
        held = F.col("content").isNotNull()
        right = holds(F.col("content"), F.col("pattern"), F.col("exclusion_type"))
        hits.append(candidates.filter(held & right).select("digest"))
        long = texts.filter(~short).select("digest", "content").dropDuplicates(["digest"])
        hits.append(candidates.filter(~held).drop("content").join(long.hint("merge"), "digest").filter(right).select("digest"))
    met = lambda t: t.filter(F.exists("_rules", lambda r: F.coalesce(holds(F.col("content"), r["pattern"], r["exclusion_type"]), F.lit(False)))).select("digest")
    rule = F.struct("pattern", "exclusion_type")
    if 0 < n_loose["all"] - n_loose["own"] <= loose_rules:
        # the few rules for everyone that have no literal meet each text where it is read
        hits.append(met(texts.withColumn("_rules", loose.filter(F.col("scope").isNull()).agg(F.collect_list(rule).alias("r")).scalar())))
        loose, n_loose = loose.filter(F.col("scope").isNotNull()), {"all": n_loose["own"], "own": n_loose["own"]}
    if n_loose["all"]:
        # rules without a literal: arrays of at most about ``loose_rules``, each text meets those of its scopes
        sizes = loose.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / loose_rules).alias("_parts"))
        parts = loose.alias("l").join(sizes.alias("s").hint("merge"), F.col("l.scope").eqNullSafe(F.col("s.scope"))).select(
            F.when(F.col("l.scope").isNull(), everyone).otherwise(F.concat(F.lit("="), F.col("l.scope").cast("string"))).alias("_scope"),
            F.pmod(F.xxhash64("pattern"), F.col("_parts")).alias("_part"), rule.alias("_rule"),
        )
        arrays = parts.groupBy("_scope", "_part").agg(F.collect_list("_rule").alias("_rules"))
        arrays = arrays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = texts.dropDuplicates(["digest"]).withColumn("_scope", asking(n_loose)).withColumn("_salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int"))
        hits.append(met(salted.join(arrays.hint("merge"), ["_scope", "_salt"])))
    return reduce(DataFrame.unionByName, hits, texts.limit(0).select("digest")).distinct()
