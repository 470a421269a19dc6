"""Access control and identity (A-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.scalars import fact_category
from paperloom.operators import access as A
from paperloom.operators.memory import latest_person_facts
from paperloom.suite.registry import query
from paperloom.suite.shapes import load

_MATRIX = ", ".join(f"('{r}', '{t}', '{level}')" for r, grants in rules.ACCESS_MATRIX.items() for t, level in grants.items())
_MATRIX_CTE = f"matrix(m_role, m_table, level) AS (VALUES {_MATRIX})"


@query(
    "a01_access_check",
    f"""WITH {_MATRIX_CTE} SELECT request_id, level IS NOT NULL AND CASE required WHEN 'none' THEN true WHEN 'metadata' THEN level <> 'none' WHEN 'read' THEN level IN ('read', 'read_write')
      WHEN 'write' THEN level IN ('write', 'read_write') ELSE level = 'read_write' END AS allowed
    FROM px_requests LEFT JOIN matrix ON m_role = role AND m_table = table_name""",
    ("requests",),
)
def a01(spark, sf):
    c = F.col
    return load(spark, sf, "requests").select("request_id", A.access_allowed(c("role"), c("table_name"), c("required")).alias("allowed"))


@query(
    "a02_accessible_tables",
    f"""WITH {_MATRIX_CTE} SELECT request_id, coalesce(n, 0) AS readable FROM px_requests LEFT JOIN (
      SELECT m_role, count(*) AS n FROM matrix WHERE level IN ('read', 'read_write') GROUP BY 1) ON m_role = role""",
    ("requests",),
)
def a02(spark, sf):
    return load(spark, sf, "requests").select("request_id", F.size(A.accessible_tables(F.col("role"), "read")).cast("long").alias("readable"))


@query(
    "a03_role_permissions",
    f"""WITH {_MATRIX_CTE} SELECT role, m_table AS table_name, level, count(*) AS requests FROM px_requests JOIN matrix ON m_role = role GROUP BY ALL""",
    ("requests",),
)
def a03(spark, sf):
    rows = load(spark, sf, "requests").select("role", F.explode(A.role_permissions(F.col("role"))).alias("table_name", "level"))
    return rows.groupBy("role", "table_name", "level").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "a04_projection",
    """SELECT doc_id, role, doc_type, vendor, review_state, len(tags)::INTEGER AS n_tags, CASE WHEN role = 'librarian' THEN md5(raw_text) END AS text_digest,
      CASE WHEN role = 'librarian' THEN source END AS source, CASE WHEN role = 'librarian' THEN filename END AS filename
    FROM px_documents CROSS JOIN (VALUES ('orchestrator'), ('librarian')) r(role)""",
    ("documents",),
)
def a04(spark, sf):
    """Both projections with their values; what the metadata role may not see is missing there and reads as NULL here."""
    docs = load(spark, sf, "documents")

    def shown(role):
        seen = A.project_documents(docs, role)
        of = lambda c, value=lambda x: x: value(F.col(c)) if c in seen.columns else F.lit(None).cast("string")
        return seen.select(
            "doc_id", F.lit(role).alias("role"), "doc_type", "vendor", "review_state", F.size("tags").alias("n_tags"),
            of("raw_text", F.md5).alias("text_digest"), of("source").alias("source"), of("filename").alias("filename"),
        )

    return shown("orchestrator").unionByName(shown("librarian"))


_WHO = """who AS (SELECT request_id, arg_min(member_id, (created_at IS NULL, created_at, CAST(member_id AS VARCHAR))) AS member_id
    FROM px_requests r JOIN (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM px_members) m
      ON m.phone IN (r.phone, regexp_replace(split_part(r.phone, '@', 1), '^$', ''), '9725' || right(regexp_replace(split_part(r.phone, '@', 1), '[^0-9]', '', 'g'), 8), '+9725' || right(regexp_replace(split_part(r.phone, '@', 1), '[^0-9]', '', 'g'), 8),
        '05' || right(regexp_replace(split_part(r.phone, '@', 1), '[^0-9]', '', 'g'), 8), '+05' || right(regexp_replace(split_part(r.phone, '@', 1), '[^0-9]', '', 'g'), 8))
    GROUP BY 1)"""


@query(
    "a07_member_by_phone",
    f"WITH {_WHO} SELECT request_id, who.member_id FROM px_requests LEFT JOIN who USING (request_id)",
    ("requests", "members"),
)
def a07(spark, sf):
    return A.members_by_phone(load(spark, sf, "requests"), load(spark, sf, "members")).select("request_id", "member_id")


@query(
    "a05_member_permission",
    f"""WITH {_WHO}, grants(g_role, g_resource, can_read, can_write) AS (VALUES {', '.join(str(g).replace('True', 'true').replace('False', 'false') for g in rules.ROLE_GRANTS)})
    SELECT request_id, coalesce(CASE action WHEN 'read' THEN can_read ELSE can_write END, false) AS allowed
    FROM px_requests LEFT JOIN who USING (request_id) LEFT JOIN px_members m ON m.member_id = who.member_id AND m.is_active LEFT JOIN grants ON g_role = m.role AND g_resource = resource""",
    ("requests", "members"),
)
def a05(spark, sf):
    # a low limit sends often-used phones through the path for hot keys
    checked = A.check_permissions(load(spark, sf, "requests"), load(spark, sf, "members"), A.role_grants(spark), hot_rows=12)
    return checked.select("request_id", "allowed")


@query(
    "a06_category_policy",
    """SELECT fact_id, role IS NOT NULL AND (fact_key NOT IN ('financial_salary', 'health_note') OR role = 'parent') AS visible
    FROM px_member_facts LEFT JOIN px_members ON member_id = (fact_id % 1700)""",
    ("member_facts", "members"),
)
def a06(spark, sf):
    facts = load(spark, sf, "member_facts").withColumn("member_id", F.col("fact_id") % 1700)
    rows = facts.join(load(spark, sf, "members").select("member_id", "role"), "member_id", "left")
    visible = A.may_read_category(F.col("role"), fact_category(F.col("fact_key"))) & F.col("role").isNotNull()
    return rows.select("fact_id", F.coalesce(visible, F.lit(False)).alias("visible"))


@query(
    "a08_member_by_name",
    """SELECT request_id, m.member_id FROM px_requests LEFT JOIN px_members m ON lower(m.name) = lower(trim(person)) AND m.is_active""",
    ("requests", "members"),
)
def a08(spark, sf):
    return A.members_by_name(load(spark, sf, "requests"), load(spark, sf, "members")).select("request_id", "member_id")


@query(
    "a09_person_reference",
    """WITH s AS (SELECT subject_member_id, max_by(fact_value, (created_at, fact_id)) AS spouse FROM px_member_facts WHERE fact_key = 'spouse' AND is_active AND subject_member_id IS NOT NULL GROUP BY 1),
      r AS (SELECT request_id, request_id % 150 AS actor_id, CASE request_id % 3 WHEN 0 THEN 'My' WHEN 1 THEN 'my wife' ELSE person END AS person FROM px_requests)
    SELECT request_id, CASE request_id % 3 WHEN 0 THEN actor_id WHEN 1 THEN w.member_id ELSE m.member_id END AS target_id
    FROM r LEFT JOIN px_members m ON lower(m.name) = lower(trim(person)) AND m.is_active LEFT JOIN s ON subject_member_id = actor_id LEFT JOIN px_members w ON lower(w.name) = lower(spouse) AND w.is_active""",
    ("requests", "members", "member_facts"),
)
def a09(spark, sf):
    k = F.col("request_id")
    requests = load(spark, sf, "requests").select(
        "request_id", (k % 150).alias("actor_id"), F.when(k % 3 == 0, F.lit("My")).when(k % 3 == 1, F.lit("my wife")).otherwise(F.col("person")).alias("person")
    )
    latest = latest_person_facts(load(spark, sf, "member_facts").withColumn("category", fact_category(F.col("fact_key"))))
    return A.resolve_people(requests, load(spark, sf, "members"), latest).select("request_id", "target_id")


@query(
    "a10_assignee",
    """WITH t AS (SELECT request_id, CASE request_id % 4 WHEN 1 THEN substring(lower(trim(person)), 2) ELSE lower(trim(person)) END AS target FROM px_requests),
      e AS (SELECT lower(name) AS name, count(*) AS n, min(member_id) AS id FROM px_members WHERE is_active GROUP BY 1),
      p AS (SELECT target, count(*) AS n, min(member_id) AS id FROM (SELECT DISTINCT target FROM t) JOIN px_members ON is_active AND contains(lower(name), target) GROUP BY 1)
    SELECT request_id, CASE WHEN coalesce(e.n, p.n) = 1 THEN coalesce(e.id, p.id) END AS member_id,
      CASE WHEN coalesce(e.n, p.n) IS NULL THEN 'not_found' WHEN coalesce(e.n, p.n) > 1 THEN 'ambiguous' WHEN e.n IS NOT NULL THEN 'exact' ELSE 'partial' END AS outcome
    FROM t LEFT JOIN e ON e.name = target LEFT JOIN p USING (target)""",
    ("requests", "members"),
)
def a10(spark, sf):
    return A.resolve_assignees(load(spark, sf, "requests"), load(spark, sf, "members")).select("request_id", "member_id", "outcome")
