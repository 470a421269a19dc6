"""Memories with exclusion rules and expiry; versioned personal and household facts (P-*)."""
from __future__ import annotations

import re
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom import rules
from paperloom.functions.regex import capture, contains_any, dialect, first_match, literal_map, strip
from paperloom.functions.scalars import fact_category
from paperloom.operators.access import may_read_category, resolve_people
from paperloom.operators import rule_index
from paperloom.operators.classify import worth_remembering

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEW_RULES = 500  # global rules, or rules of one member, that are kept as one array


def default_rules(spark: SparkSession) -> DataFrame:
    """The seeded global rules: pattern, exclusion_type, member_id (NULL = everyone), is_active."""
    rows = [(p, kind, None, True) for p, kind in rules.MEMORY_EXCLUSIONS]
    return spark.createDataFrame(rows, "pattern string, exclusion_type string, member_id bigint, is_active boolean")


def java_pattern(pattern: str) -> str | None:
    """A member's regex, written for Python, in Java's spelling; None if it does not compile.

    ``(?U)`` gives classes, word edges and case folding their Unicode meaning, ``(?d)`` makes only a line feed a line end. Group
    names lose what Java does not allow in them, and signs that Java reads as set operators are escaped inside a class.
    """
    try:
        names = {name: f"g{number}" for name, number in re.compile(pattern).groupindex.items()}
    except (re.error, OverflowError, RecursionError):
        return None
    out, at, inside = [], 0, False
    while at < len(pattern):
        two, one = pattern[at : at + 2], pattern[at]
        if one == "\\":
            out.append("\\z" if two == "\\Z" and not inside else two)
            at += 2
        elif inside:
            first = at == opened
            if one == "]" and not first:
                inside = False
            out.append("\\" + one if one in "[&" or one == "]" and first else one)
            at += 1
        elif one == "[":
            inside, negated = True, pattern[at + 1 : at + 2] == "^"
            out.append("[^" if negated else "[")
            at += 2 if negated else 1
            opened = at
        elif named := re.match(r"\(\?P<(\w+)>|\(\?P=(\w+)\)", pattern[at:]):
            out.append(f"(?<{names[named[1]]}>" if named[1] else rf"\k<{names[named[2]]}>")
            at += named.end()
        else:
            out.append(one)
            at += 1
    return "(?dU)" + "".join(out)


@F.pandas_udf(StringType())
def _java(pattern: pd.Series) -> pd.Series:
    """Runs over the rule table only."""
    return pattern.map(lambda p: None if p is None else java_pattern(p))


def _usable(rule_table: DataFrame) -> DataFrame:
    """Active keyword and regex rules. A regex is ignored, like a rule of another type, if it is not valid for its writer
    (Python) or for the engine that will run it: one member's rule must not end everybody's job."""
    active = rule_table.filter(F.col("is_active")).withColumn("written", F.col("pattern"))
    keyword = active.filter(F.col("exclusion_type") == "keyword").withColumn("pattern", F.lower("pattern"))
    regex = active.filter(F.col("exclusion_type") == "regex").withColumn("pattern", _java("pattern"))
    # NULL where Java cannot compile the pattern
    regex = regex.filter(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull())
    both = keyword.unionByName(regex).filter(F.col("pattern").isNotNull())
    return both.select(F.col("member_id").cast("long").alias("scope"), "pattern", "written", "exclusion_type")


def _matches(packed: Column, content: Column) -> Column:
    hit = lambda r: rule_index.holds(content, r["pattern"], r["exclusion_type"])
    return F.coalesce(F.exists(packed, hit), F.lit(False))


def mark_excluded(
    contents: DataFrame, rule_table: DataFrame, key: str, content: str = "content", member: str = "member_id", few: int = FEW_RULES
) -> DataFrame:
    """P-01: add ``excluded``: a global rule or one of the member's own matches the content. Each row decides for itself.

    The rules are counted first. Up to ``few`` global rules are one array that the plan computes once and hands to every
    task, so contents do not move for them; up to ``few`` rules a member are an array per member, joined on the member as
    Spark sees fit (rows without a member, which have none, are spread over the join). Beyond that the rules of that side
    are filed by a piece of their text and meet only contents that hold it (``rule_index``): no row holds all rules.
    """
    active = rule_table.filter(F.col("is_active")).groupBy(F.col("member_id").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    counts = active.agg(F.max(F.when(F.col("m").isNull(), F.col("n"))).alias("everyone"), F.max(F.when(F.col("m").isNotNull(), F.col("n"))).alias("own")).first()
    usable, is_global = _usable(rule_table), F.col("scope").isNull()
    filed, out, hits = None, contents, []
    packed = F.collect_list(F.struct("pattern", "exclusion_type"))
    if (counts["everyone"] or 0) <= few:
        out = out.withColumn("_everyone", usable.filter(is_global).agg(packed.alias("r")).scalar())
        hits.append(_matches(F.col("_everyone"), F.col(content)))
    else:
        filed = usable.filter(is_global)
    if (counts["own"] or 0) > few:
        filed = usable.filter(~is_global) if filed is None else usable
    elif counts["own"]:
        own = usable.filter(~is_global).groupBy(F.col("scope").alias("_scope")).agg(packed.alias("_own")).withColumn("_none", F.lit(False))
        rows = out.withColumns({"_none": F.col(member).isNull(), "_scope": F.coalesce(F.col(member).cast("long"), F.xxhash64(key))})
        out = rows.join(own, ["_scope", "_none"], "left").drop("_scope", "_none")
        hits.append(_matches(F.col("_own"), F.col(content)))
    if filed is not None:
        # 128 bits for a scope and its text
        scope = F.col(member).cast("long")
        digest = F.unhex(F.left(F.sha2(F.concat(F.coalesce(scope.cast("string"), F.lit("*")), F.lit("="), F.col(content)), 256), F.lit(32)))
        texts = contents.filter(F.col(content).isNotNull()).select(scope.alias("scope"), digest.alias("digest"), F.col(content).alias("content"))
        found = rule_index.matched(texts, filed).select(F.col("digest").alias("_digest"), F.lit(True).alias("_hit"))
        out = out.withColumn("_digest", digest).join(found, "_digest", "left").drop("_digest")
        hits.append(F.coalesce("_hit", F.lit(False)))
    return out.withColumn("excluded", reduce(lambda a, b: a | b, hits, F.lit(False))).drop("_everyone", "_own", "_hit")


def memory_category(category: Column) -> Column:
    """P-02: unknown categories map to known ones."""
    mapped = F.coalesce(F.try_element_at(literal_map(rules.MEMORY_CATEGORY_MAP), category), F.lit(rules.MEMORY_DEFAULT_CATEGORY))
    return F.when(category.isin(rules.MEMORY_CATEGORIES), category).otherwise(mapped)


def expiry(created_at: Column, memory_type: Column) -> Column:
    """P-02: NULL for permanent and unknown types."""
    days = {k: v for k, v in rules.MEMORY_TTL_DAYS.items() if v is not None}
    table = F.create_map(*[x for k, v in days.items() for x in (F.lit(k), F.lit(v))])
    return F.timestamp_add("DAY", F.try_element_at(table, memory_type), created_at)


def save_memories(candidates: DataFrame, rule_table: DataFrame, key: str = "memory_id") -> DataFrame:
    """P-02: the rows to store: not excluded, category mapped, expiry set."""
    kept = mark_excluded(candidates, rule_table, key).filter(~F.col("excluded")).drop("excluded")
    return kept.withColumns(
        {"category": memory_category(F.col("category")), "expires_at": expiry(F.col("created_at"), F.col("memory_type"))}
    )


def load_memories(memories: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """P-03: per member the most recently used live memories; the rank limit also applies before the shuffle."""
    live = memories.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    order = [F.col("last_accessed_at").desc_nulls_last(), F.col("created_at").desc_nulls_first(), F.col("memory_id")]
    ranked = live.withColumn("position", F.row_number().over(Window.partitionBy("member_id").orderBy(*order)))
    return ranked.filter(F.col("position") <= limit)


def touch_memories(memories: DataFrame, loaded: DataFrame, as_of: Column) -> DataFrame:
    """P-04: count the access of the memories that were handed out."""
    used = loaded.select("memory_id", F.lit(True).alias("_used"))
    joined = memories.join(used, "memory_id", "left")
    count = F.coalesce("access_count", F.lit(0))
    return joined.withColumns(
        {
            "access_count": F.when(F.col("_used"), count + 1).otherwise(F.col("access_count")),
            "last_accessed_at": F.when(F.col("_used"), as_of).otherwise(F.col("last_accessed_at")),
        }
    ).drop("_used")


def is_expired(as_of: Column) -> Column:
    return F.col("expires_at").isNotNull() & (F.col("expires_at") <= as_of)


def drop_expired(memories: DataFrame, as_of: Column) -> DataFrame:
    """P-05."""
    return memories.filter(~is_expired(as_of))


def expired_count(memories: DataFrame, as_of: Column) -> DataFrame:
    """P-05."""
    return memories.agg(F.count_if(is_expired(as_of)).alias("deleted"))


def nudge_memories(messages: DataFrame, rule_table: DataFrame) -> DataFrame:
    """P-06: messages worth remembering become long-lived facts. ``messages``: message_id, member_id, ts, message_in."""
    worth = messages.filter(worth_remembering(F.col("message_in"))).select(
        "message_id", "member_id", F.col("ts").alias("created_at"), F.col("message_in").alias("content")
    )
    kept = mark_excluded(worth, rule_table, "message_id").filter(~F.col("excluded")).drop("excluded")
    return kept.withColumns(
        {
            "content": F.substring(strip(F.col("content")), 1, rules.NUDGE_CONTENT_CAP), "category": F.lit("fact"),
            "memory_type": F.lit("long"), "source": F.lit("nudge"), "confidence": F.lit(0.8),
            "expires_at": expiry(F.col("created_at"), F.lit("long")),
        }
    )


def fact_versions(statements: DataFrame) -> DataFrame:
    """P-07: rows to append; the category follows from the key where none is given.

    ``statements``: fact_id, subject_member_id or location_key, fact_key, fact_value, category, created_by, created_at.
    """
    return statements.withColumns({"category": F.coalesce("category", fact_category(F.col("fact_key"))), "is_active": F.lit(True)})


def _latest(facts: DataFrame, subject: str) -> DataFrame:
    row = F.struct("fact_id", "fact_value", "category", "created_at")
    active = facts.filter(F.col("is_active") & F.col(subject).isNotNull())
    return active.groupBy(subject, "fact_key").agg(F.max_by(row, F.struct("created_at", "fact_id")).alias("f")).select(subject, "fact_key", "f.*")


def latest_person_facts(facts: DataFrame) -> DataFrame:
    """P-08: the newest active version per (member, key); a partial aggregate, no sort of a member's history."""
    return _latest(facts, "subject_member_id")


def latest_household_facts(facts: DataFrame) -> DataFrame:
    """P-08: per (location, key)."""
    return _latest(facts, "location_key")


_SELF_TOKENS = ["i ", " i", "אני", "שלי", "נולדתי", "my id", "תז שלי"]
_OF_NAME = r"(?:of|של)\s+([\p{L}\p{N}_]+)"


def answer_fact_questions(requests: DataFrame, members: DataFrame, facts: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """P-09: whom a question is about -> that member's newest fact -> may the actor read its category.

    ``requests``: request_id, actor_id, question, fact_key. The subject is the actor for first-person wording, else the
    name after 'of', else the first word that names somebody, else the actor.
    """
    latest = latest_person_facts(facts)
    text = F.col("question")
    named = capture(text, _OF_NAME, 1)
    how = first_match(
        [(contains_any(F.lower(text), _SELF_TOKENS), F.lit("self")), (text.rlike(dialect(_OF_NAME)), F.lit("named"))], F.lit("words")
    )
    plan = requests.withColumns({"_how": how})
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    tokens = F.when(F.col("_how") == "words", words).when(F.col("_how") == "named", F.array(named)).otherwise(F.array().cast("array<string>"))
    asked = plan.select("request_id", "actor_id", F.posexplode_outer(tokens).alias("_pos", "person")).filter(F.col("person").isNotNull())
    found = resolve_people(asked, members, latest, aliases).filter(F.col("target_id").isNotNull())
    first = found.groupBy("request_id").agg(F.min_by("target_id", "_pos").alias("_found"))
    rows = plan.join(first, "request_id", "left").withColumn(
        "target_id", F.when(F.col("_how") == "named", F.col("_found")).otherwise(F.coalesce("_found", "actor_id"))
    )
    values = latest.select(F.col("subject_member_id").alias("target_id"), "fact_key", "fact_value", "category")
    roles = members.select(F.col("member_id").alias("actor_id"), "role")
    rows = rows.join(values, ["target_id", "fact_key"], "left").join(roles, "actor_id", "left")
    allowed = F.coalesce(may_read_category(F.col("role"), F.col("category")), F.lit(False))
    outcome = first_match(
        [
            (F.col("target_id").isNull(), F.lit("unknown_person")), (F.col("fact_value").isNull(), F.lit("no_fact")),
            (~allowed, F.lit("denied")),
        ],
        F.lit("answered"),
    )
    return rows.select("request_id", "target_id", outcome.alias("outcome"), F.when(outcome == "answered", F.col("fact_value")).alias("answer"))


def answer_location_questions(requests: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """P-09 for places: the newest building code of the location a question names.

    ``requests``: request_id, actor_id, question.
    """
    codes = latest_household_facts(facts).filter(F.col("fact_key") == "building_code").select("location_key", "fact_value", "category")
    roles = members.select(F.col("member_id").alias("actor_id"), "role")
    rows = requests.withColumn("location_key", strip(F.lower("question"))).join(codes, "location_key", "left").join(roles, "actor_id", "left")
    allowed = F.coalesce(may_read_category(F.col("role"), F.col("category")), F.lit(False))
    outcome = first_match([(F.col("fact_value").isNull(), F.lit("no_fact")), (~allowed, F.lit("denied"))], F.lit("answered"))
    return rows.select("request_id", outcome.alias("outcome"), F.when(outcome == "answered", F.col("fact_value")).alias("answer"))
