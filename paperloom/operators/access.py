"""Roles, grants and people (A-*)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import first_match, literal_array, non_blank, strip
from paperloom.functions.scalars import canonical_phone, normalize_member_name, normalize_name, phone_candidates
from paperloom.operators.skew import HOT_ROWS, lookup


class AccessDenied(Exception):
    """The role lacks the level a read needs; raised while the plan is built, before any data is read."""


def granted_level(role: str, table: str) -> str:
    return rules.ACCESS_MATRIX.get(role, {}).get(table, "none")


def check_access(role: str, table: str, required: str) -> bool:
    """A-01 for one request, at plan time; an unknown role is denied."""
    return role in rules.ACCESS_MATRIX and granted_level(role, table) in rules.ACCESS_GRANTS[required]


def require(role: str, table: str, required: str) -> None:
    if not check_access(role, table, required):
        raise AccessDenied(f"role '{role}' lacks '{required}' access to '{table}'")


def access_allowed(role: Column, table: Column, required: Column) -> Column:
    """A-01 for a table of requests: the matrix is a literal of fixed size."""
    granted = F.create_map(
        *[x for r, grants in rules.ACCESS_MATRIX.items() for t, level in grants.items() for x in (F.lit(f"{r}/{t}"), F.lit(level))]
    )
    satisfied = F.create_map(*[x for level, ok in rules.ACCESS_GRANTS.items() for x in (F.lit(level), literal_array(ok))])
    level = F.coalesce(F.try_element_at(granted, F.concat_ws("/", role, table)), F.lit("none"))
    allowed = F.array_contains(F.try_element_at(satisfied, required), level)
    return role.isin(list(rules.ACCESS_MATRIX)) & F.coalesce(allowed, F.lit(False))


def accessible_tables(role: Column, min_level: str = "metadata") -> Column:
    """A-02: the tables a role reaches at a level, in matrix order; empty for an unknown role."""
    tables = {r: [t for t in grants if check_access(r, t, min_level)] for r, grants in rules.ACCESS_MATRIX.items()}
    listed = F.create_map(*[x for r, names in tables.items() for x in (F.lit(r), literal_array(names))])
    return F.coalesce(F.try_element_at(listed, role), F.array().cast("array<string>"))


def role_permissions(role: Column) -> Column:
    """A-03: map table -> level; empty for an unknown role."""
    cases = [
        (role == r, F.create_map(*[x for t, level in grants.items() for x in (F.lit(t), F.lit(level))]))
        for r, grants in rules.ACCESS_MATRIX.items()
    ]
    return first_match(cases, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def project_documents(documents: DataFrame, role: str) -> DataFrame:
    """A-04: the columns a role may see; the rest is never read from the files."""
    require(role, "documents", "metadata")
    full = check_access(role, "documents", "read")
    return documents.select(*(rules.FULL_COLUMNS if full else rules.METADATA_COLUMNS))


def role_grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.ROLE_GRANTS, "role string, resource string, can_read boolean, can_write boolean")


def members_by_phone(
    requests: DataFrame, members: DataFrame, phone: str = "phone", hot_rows: int = HOT_ROWS, also: dict[str, Column] | None = None
) -> DataFrame:
    """A-07: add ``member_id``: among the spellings' matches the canonical ones, then the oldest, then the lowest id.

    Each distinct phone is resolved once, so one caller with very many requests costs one row there. ``also``: further values
    of the member to bring along under a name, so that no second join on the member is needed.
    """
    also = also or {}
    distinct = requests.groupBy(F.col(phone)).agg(F.count(F.lit(1)).alias("copies"))
    spelled = distinct.select(phone, "copies", F.explode(phone_candidates(F.col(phone))).alias("spelling"))
    known = members.select(
        F.col("phone").alias("spelling"), "member_id", "created_at", canonical_phone(F.col("phone")).alias("canonical"),
        *[value.alias(name) for name, value in also.items()],
    )
    order = F.struct(
        (F.col("canonical") != canonical_phone(F.col(phone))).alias("foreign"), F.col("created_at").isNull().alias("undated"),
        F.col("created_at"), F.col("member_id").cast("string").alias("id_text"),
    )
    found = spelled.join(known, "spelling").groupBy(phone, "copies").agg(F.min_by(F.struct("member_id", *also), order).alias("m"))
    best = found.select(phone, "copies", "m.*")
    return lookup(requests, best, [phone], "copies", "request_id", hot_rows)


def check_permissions(requests: DataFrame, members: DataFrame, grants: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A-05: add ``allowed``; false for unknown or inactive callers and missing grants.

    ``requests``: request_id, phone, resource, action (read/write).
    """
    who = members_by_phone(requests, members, hot_rows=hot_rows, also={"_role": F.when(F.col("is_active"), F.col("role"))})
    given = F.broadcast(grants.withColumnRenamed("role", "_role"))  # a few rows per role
    rows = who.join(given, ["_role", "resource"], "left")
    allowed = first_match([(F.col("action") == "read", F.col("can_read")), (F.col("action") == "write", F.col("can_write"))])
    return rows.select(*requests.columns, "member_id", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def may_read_category(role: Column, category: Column) -> Column:
    """A-06."""
    return category.isin(rules.OPEN_FACT_CATEGORIES) | (category.isin(rules.PARENT_FACT_CATEGORIES) & (role == "parent"))


def members_by_name(requests: DataFrame, members: DataFrame, name: str = "person") -> DataFrame:
    """A-08: active member with that name, whatever the case; the lowest id where a name is shared."""
    by_name = members.filter("is_active").groupBy(F.lower("name").alias("_name")).agg(F.min("member_id").alias("member_id"))
    wanted = requests.withColumn("_name", non_blank(F.lower(strip(F.col(name)))))
    return wanted.join(by_name, "_name", "left").drop("_name")


def resolve_people(requests: DataFrame, members: DataFrame, latest_facts: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """A-09: add ``target_id``: self words, then an exact active name, then the actor's recorded spouse by name.

    ``requests``: request_id, actor_id, person; ``latest_facts``: the newest fact per (subject, key).
    """
    by_name = members.filter("is_active").groupBy(normalize_name(F.col("name"), aliases).alias("_name")).agg(F.min("member_id").alias("_id"))
    spouses = latest_facts.filter((F.col("fact_key") == "spouse") & (F.col("category") == "basic_personal")).select(
        F.col("subject_member_id").alias("actor_id"), normalize_name(F.col("fact_value"), aliases).alias("_spouse")
    )
    ref = requests.withColumn("_name", non_blank(normalize_name(F.col("person"), aliases)))
    named = ref.join(by_name.withColumnRenamed("_id", "_named"), "_name", "left").join(spouses, "actor_id", "left")
    # one more step: the spouse's own name, or a self word recorded as the spouse
    wed = named.join(by_name.select(F.col("_name").alias("_spouse"), F.col("_id").alias("_wed")), "_spouse", "left")
    spouse_id = F.when(F.col("_spouse").isin(rules.SELF_WORDS), F.col("actor_id")).otherwise(F.col("_wed"))
    target = first_match(
        [
            (F.col("_name").isin(rules.SELF_WORDS), F.col("actor_id")),
            (F.col("_named").isNotNull(), F.col("_named")),
            (F.col("_name").isin(rules.SPOUSE_WORDS), spouse_id),
        ]
    )
    return wed.select(*requests.columns, target.alias("target_id"))


def _substrings(name: Column, lengths: Column) -> Column:
    """Every distinct substring of the given lengths; names are short, so this stays a small array."""
    fit = F.filter(lengths, lambda n: (n >= 1) & (n <= F.length(name)))
    pieces = F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n))))
    return F.array_distinct(pieces)


def resolve_assignees(requests: DataFrame, members: DataFrame, name: str = "person") -> DataFrame:
    """A-10: add ``member_id`` and ``outcome``: unique exact name, else unique name containing it, else ambiguous / not_found / unspecified.

    "Contains" is an equality join on the names' substrings, of the lengths that are asked for, folded per substring first: no
    pair of a request and a member is ever formed. The folded sides come by shuffle: how much the substrings hold is not seen from the members' table.
    """
    active = members.filter("is_active").select("member_id", normalize_member_name(F.col("name")).alias("_name")).filter(F.col("_name") != "")
    wanted = requests.withColumn("_name", non_blank(normalize_member_name(F.coalesce(F.col(name), F.lit("")))))
    lengths = wanted.agg(F.collect_set(F.length("_name")).alias("n")).scalar()
    fold = lambda df: df.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), F.min("member_id").alias("id"))
    exact = fold(active).select("_name", F.struct("n", "id").alias("exact")).hint("merge")
    cut = active.withColumn("_lengths", lengths).select("member_id", F.explode(_substrings(F.col("_name"), F.col("_lengths"))).alias("_name"))
    partial = fold(cut).select("_name", F.struct("n", "id").alias("partial")).hint("merge")
    rows = wanted.join(exact, "_name", "left").join(partial, "_name", "left")
    one = F.when(F.col("exact").isNotNull(), F.col("exact")).otherwise(F.col("partial"))
    outcome = first_match(
        [
            (F.col("_name").isNull(), F.lit("unspecified")), (one.isNull(), F.lit("not_found")), (one["n"] > 1, F.lit("ambiguous")),
            (F.col("exact").isNotNull(), F.lit("exact")),
        ],
        F.lit("partial"),
    )
    return rows.select(*requests.columns, F.when(one["n"] == 1, one["id"]).alias("member_id"), outcome.alias("outcome"))
