"""Household-shaped inputs derived from the given tables.

The given corpus holds no invoices, salary slips or tasks, so each shape maps a given table row by row to
one domain table (orders -> documents, lineitem -> facts, ...). Every shape grows with its table. One
template renders both dialects, so Spark and the SQL check read the same input.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom import rules
from paperloom.session import spread
from paperloom.streaming import jobs

# texts on which regexes run: spread over the cores before the work starts
HEAVY_SHAPES = {"documents", "bills", "slips", "messages"}
WAVES = 8  # the texts are written from narrow rows: a table of few bytes holds very many


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The real corpus, spread for regex work."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _quoted(values: list[str]) -> str:
    return ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)


class SparkDialect:
    lb, rb = "{{", "}}"

    def t(self, name):
        return "{" + name + "}"

    def pick(self, values, index):
        return f"element_at(array({_quoted(values)}), cast({index} + 1 as int))"

    def dmy(self, d):
        return f"date_format({d}, 'dd/MM/yyyy')"

    def dots(self, d):
        return f"date_format({d}, 'dd.MM.yyyy')"

    def iso(self, d):
        return f"date_format({d}, 'yyyy-MM-dd')"

    def seconds(self, ts, n):
        return f"timestampadd(SECOND, cast({n} as int), {ts})"

    def days(self, d, n):
        return f"date_add({d}, cast({n} as int))"

    def stamp(self, ts):
        return f"cast({ts} as timestamp)"

    def int(self, x):
        return f"cast({x} as int)"

    def text(self, x):
        return f"cast({x} as string)"

    def money_text(self, x):
        return f"cast(cast({x} as decimal(18,2)) as string)"

    def commas(self, x):
        return f"format_number({x}, 2)"

    def json(self, x):
        return f"substring(to_json(named_struct('v', {x})), 6, length(to_json(named_struct('v', {x}))) - 6)"

    def lpad(self, x, n):
        return f"lpad(cast({x} as string), {n}, '0')"

    def list(self, *values):
        return f"array({', '.join(values)})"

    nl = "'\\n'"


class DuckDialect:
    lb, rb = "{", "}"

    def t(self, name):
        return name

    def pick(self, values, index):
        return f"list_value({_quoted(values)})[{index} + 1]"

    def dmy(self, d):
        return f"strftime({d}, '%d/%m/%Y')"

    def dots(self, d):
        return f"strftime({d}, '%d.%m.%Y')"

    def iso(self, d):
        return f"strftime({d}, '%Y-%m-%d')"

    def seconds(self, ts, n):
        return f"({ts} + to_seconds({n}))"

    def days(self, d, n):
        return f"({d} + CAST({n} AS INTEGER))"

    def stamp(self, ts):
        return f"CAST({ts} AS TIMESTAMP)"

    def int(self, x):
        return f"CAST({x} AS INTEGER)"

    def text(self, x):
        return f"CAST({x} AS VARCHAR)"

    def money_text(self, x):
        return f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"

    def commas(self, x):
        return "format('{:,.2f}', CAST(" + x + " AS DOUBLE))"

    def json(self, x):
        return f"CAST(to_json({x}) AS VARCHAR)"

    def lpad(self, x, n):
        return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"

    def list(self, *values):
        return f"list_value({', '.join(values)})"

    nl = "chr(10)"


SHAPES: dict[str, tuple[tuple[str, ...], Callable]] = {}


def shape(*tables: str):
    def add(fn):
        SHAPES[fn.__name__] = (tables, fn)
        return fn

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The shape as a DataFrame."""
    tables, fn = SHAPES[name]
    needed = {t: table(spark, sf, t) for t in tables}
    if name in HEAVY_SHAPES:
        needed[tables[0]] = spread(needed[tables[0]], WAVES)
    return spark.sql(fn(SparkDialect()), **needed)


def load_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The shape with its first table as a stream; other tables are read as they are."""
    tables, fn = SHAPES[name]
    return spark.sql(fn(SparkDialect()), **{t: table(spark, sf, t) if i else jobs.stream_table(spark, sf, t) for i, t in enumerate(tables)})


def with_clause(names: tuple[str, ...]) -> str:
    """WITH px_<name> AS (...) for the SQL check."""
    if not names:
        return ""
    return "WITH " + ",\n".join(f"px_{n} AS ({SHAPES[n][1](DuckDialect())})" for n in names) + "\n"


PHRASES = [
    "Invoice", "קבלה על תשלום", "rental agreement", "Insurance policy", "Statement of account", "מתכון לעוגה", "Note",
]
SOURCES = ["whatsapp", "email", "filesystem", "manual", "text_message", "api"]
EXTENSIONS = [".pdf", ".PDF", ".png", ".docx", ".xlsx", ".txt", ".jpeg"]


@shape("orders", "customer")
def documents(d):
    """One document per order: a short text with a date and an amount, and partly filled columns."""
    k = "o_orderkey"
    amount = f"cast(o_totalprice as decimal(18,2))"
    return f"""
    SELECT o_orderkey AS doc_id,
      o_custkey % 20 AS uploaded_by,
      {d.pick(rules.CATEGORIES, f'{k} % 13')} AS doc_type,
      CASE WHEN {k} % 5 = 0 THEN NULL ELSE c_name END AS vendor,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE {amount} END AS amount,
      CASE WHEN {k} % 3 = 0 THEN NULL ELSE 'ILS' END AS currency,
      CASE WHEN {k} % 6 = 0 THEN NULL ELSE cast(o_orderdate as date) END AS doc_date,
      {d.stamp(d.seconds('o_orderdate', f'{k} % 86400'))} AS created_at,
      cast({k} % 10 as double) / 10 AS confidence,
      {d.pick(['needs_review', 'auto_verified', 'pending'], "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END")} AS review_state,
      concat({d.pick(rules.CATEGORIES, f'{k} % 13')}, '_', {d.text(k)}, '_', {d.text('year(o_orderdate)')}, {d.pick(EXTENSIONS, f'{k} % 7')}) AS filename,
      CASE WHEN {k} % 11 = 0 THEN '  ' ELSE concat({d.pick(PHRASES, f'{k} % 7')}, ' ', {d.text(k)}, ' Date: ', {d.dmy('o_orderdate')}, ' Total: NIS ', {d.money_text('o_totalprice')}) END AS raw_text,
      CASE WHEN {k} % 2 = 0 THEN NULL ELSE concat('Doc ', {d.text(k)}) END AS display_name,
      CASE WHEN {k} % 3 = 1 THEN NULL ELSE concat('Summary ', {d.text(k)}) END AS ai_summary,
      {d.list("'#Tax'", "concat(' ', c_mktsegment)", "concat('#', " + d.text('year(o_orderdate)') + ")", "''")} AS tags,
      {d.pick(SOURCES, f'{k} % 6')} AS source,
      cast(o_orderdate as date) AS true_date, {amount} AS true_amount
    FROM {d.t('orders')} JOIN {d.t('customer')} ON o_custkey = c_custkey
    """


DATE_KEYS = ["source_date", "period_start", "period_end", "contract_end_date"]
MONEY_KEYS = ["amount", "premium_amount", "deductible_amount", "coverage_limit"]
DISHES = ["small ring soup", "red bolt salad", "blue gear cake", "hot gizmo stew", "cold widget pie", "green nut bread"]


@shape("lineitem")
def facts(d):
    """One fact per line item; ``fact_seq`` is the position a document's facts were extracted in."""
    key = f"CASE WHEN l_orderkey % 13 = 11 THEN {d.pick(rules.RECIPE_KEYS, 'l_partkey % 5')} ELSE {d.pick(rules.FACT_KEYS, 'l_partkey % 28')} END"
    day = "cast(l_shipdate as date)"
    return f"""
    SELECT l_orderkey AS document_id, fact_seq, fact_type, fact_key,
      CASE WHEN l_partkey % 17 = 0 THEN ''
        WHEN fact_key IN ({_quoted(DATE_KEYS)}) THEN CASE l_suppkey % 4 WHEN 0 THEN {d.iso(day)} WHEN 1 THEN {d.dmy(day)} WHEN 2 THEN {d.dots(day)} ELSE 'n/a' END
        WHEN fact_key IN ({_quoted(MONEY_KEYS)}) THEN CASE l_suppkey % 3 WHEN 0 THEN {d.money_text('l_extendedprice')} WHEN 1 THEN {d.commas('l_extendedprice')} ELSE 'about ten' END
        WHEN fact_key = 'currency' THEN {d.pick(['ILS', 'USD', 'EUR'], 'l_linenumber % 3')}
        WHEN fact_key = 'recipe_name' THEN {d.pick(DISHES, 'l_suppkey % 6')}
        ELSE concat(fact_key, ' ', {d.text('l_suppkey % 50')}) END AS fact_value,
      CASE WHEN l_discount IS NULL THEN 0.5 ELSE round(l_discount * 10, 1) END AS confidence,
      CASE WHEN l_suppkey % 3 = 0 THEN '' WHEN l_orderkey % 13 = 11 THEN {d.pick(DISHES, 'l_suppkey % 6')} ELSE concat('excerpt ', {d.text('l_linenumber')}) END AS source_excerpt,
      {d.stamp('l_shipdate')} AS created_at
    FROM (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_shipdate,
        (cast(l_linenumber as bigint) * 100000000 + l_partkey) * 100000 + l_suppkey AS fact_seq,
        {d.pick(rules.CATEGORIES, 'l_orderkey % 13')} AS fact_type,
        {key} AS fact_key
      FROM {d.t('lineitem')}
    ) keyed
    """


@shape("customer")
def members(d):
    k = "c_custkey"
    return f"""
    SELECT c_custkey AS member_id, c_name AS name,
      {d.pick(['parent', 'child', 'grandparent', 'other', 'parent'], "CASE c_mktsegment WHEN 'FURNITURE' THEN 0 WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'BUILDING' THEN 3 ELSE 4 END")} AS role,
      CASE {k} % 3 WHEN 0 THEN concat('05', {d.lpad(f'{k} % 1200', 8)}) WHEN 1 THEN concat('9725', {d.lpad(f'{k} % 1200', 8)}) ELSE concat('+9725', {d.lpad(f'{k} % 1200', 8)}) END AS phone,
      c_acctbal >= 0 AS is_active, {k} % 97 = 0 AS is_admin,
      CASE WHEN {k} % 13 = 0 THEN NULL ELSE {d.stamp(d.days("date '2020-01-01'", f'{k} % 1000'))} END AS created_at
    FROM {d.t('customer')}
    """


@shape("orders")
def tasks(d):
    k = "o_orderkey"
    return f"""
    SELECT o_orderkey AS task_id,
      CASE WHEN {k} % 50 = 0 THEN '  ' WHEN {k} % 3 = 0 THEN concat('TASK ', {d.text(f'{k} % 500')}) ELSE concat('Task ', {d.text(f'{k} % 500')}) END AS title,
      CASE WHEN {k} % 31 = 0 THEN NULL ELSE o_custkey % 20 END AS created_by,
      o_custkey % 50 AS assigned_to,
      {d.pick(['open', 'done', 'in_progress'], "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END")} AS status,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' WHEN '5-LOW' THEN 'low' ELSE 'someday' END AS priority,
      CASE WHEN {k} % 7 = 0 THEN NULL ELSE {d.days('cast(o_orderdate as date)', '30')} END AS due_date,
      {d.pick(['home', 'car', 'school', 'health'], f'{k} % 4')} AS category,
      {d.stamp(d.seconds('o_orderdate', f'{k} % 86400'))} AS created_at,
      CASE WHEN {k} % 9 = 0 THEN {d.stamp(d.seconds('o_orderdate', '100000'))} ELSE NULL END AS completed_at
    FROM {d.t('orders')}
    """


@shape("orders")
def task_changes(d):
    """Change events of every third task: one each, a second for every sixth, a third for every ninth."""
    k = "o_orderkey"
    one = lambda nth, cond, after: f"""
    SELECT o_orderkey AS task_id, o_orderkey * 4 + {nth} AS change_id,
      {d.pick(['done', 'archived', 'in_progress', 'open'], f'({k} + {nth} * {k} % 7) % 4')} AS new_status,
      (o_custkey + {nth} * 5) % 37 AS new_assignee, (o_custkey + {nth}) % 11 AS actor_id,
      {d.stamp(d.seconds('o_orderdate', after))} AS changed_at
    FROM {d.t('orders')} WHERE {cond}"""
    return " UNION ALL ".join([one(0, f"{k} % 3 = 0", "200000"), one(1, f"{k} % 6 = 0", "203600"), one(2, f"{k} % 9 = 0", "207200")])


@shape("part")
def patterns(d):
    k = "p_partkey"
    return f"""
    SELECT p_partkey AS pattern_id, p_name AS title,
      {d.pick(['daily', 'weekly', 'monthly', 'yearly', 'never'], f'{k} % 5')} AS frequency,
      {d.days("date '1998-01-01'", f'{k} % 730')} AS next_due_date,
      {d.int('p_size % 10')} AS auto_create_days_before,
      p_size % 4 <> 0 AS is_active, {k} % 1600 AS assigned_to,
      {d.pick(['home', 'car', 'school', 'health'], f'{k} % 4')} AS category
    FROM {d.t('part')}
    """


LEADS = [
    "משימה חדשה: לקנות חלב", "הסכום בחשבונית", "invoice for march", "כן", "לא", "זכור ש", "תזכורת חדשה: ארנונה, חודשי, 10",
    "באג: המסך שחור", "help", "מתי נולדתי", "איך מכינים עוגה", "תודה", "remember that", "can you build", "analyze this",
    "show latest 7 documents", "מחק משימה 12", "hello", "דנה was born on 12/03/2011", "עדכן משימה 3 דחוף",
]
INTENTS = ["task.list", "agent.None", "document.query", "agent.chat", None, "chat"]


@shape("conversations")
def messages(d):
    """A user turn, its reply (the next turn) and an intent; some messages are commands only."""
    lead = d.pick(LEADS, "(u.conv_id * 7 + u.turn) % 20")
    return f"""
    SELECT u.conv_id * 100 + u.turn AS message_id, u.conv_id % 20 AS member_id,
      {d.stamp(d.seconds("timestamp '2024-01-01 00:00:00'", 'u.conv_id * 3700 + u.turn * 90'))} AS ts,
      CASE WHEN (u.conv_id + u.turn) % 3 = 0 THEN concat({lead}, ' ', u.text) ELSE {lead} END AS message_in,
      CASE WHEN u.conv_id % 17 = 3 THEN '{rules.ERROR_REPLY}' ELSE a.text END AS message_out,
      {d.pick(INTENTS, '(u.conv_id + u.turn) % 6')} AS intent
    FROM {d.t('conversations')} u LEFT JOIN {d.t('conversations')} a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'
    """


@shape("events")
def activity(d):
    """The event log as message arrivals: phone, member, time and what happened."""
    return f"""
    SELECT event_id, {d.stamp('ts')} AS ts, user_id AS member_id,
      concat('9725', {d.lpad('user_id', 8)}) AS phone, event_type, value,
      {d.pick(['task', 'document', 'memory', 'recurring', 'chat'], "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")} AS intent
    FROM {d.t('events')}
    """


MEMORY_NOTES = ["likes green tea", "the PIN is", "my Password", "runs on sunday", "הקוד של השער", "allergic to nuts", "keeps a secret"]


@shape("events")
def memories(d):
    k = "event_id"
    return f"""
    SELECT event_id AS memory_id, user_id AS member_id,
      concat({d.pick(MEMORY_NOTES, f'{k} % 7')}, ' ', {d.text(k)}) AS content,
      {d.pick(['preference', 'task', 'note', 'habit', 'mystery', 'reminder'], f'{k} % 6')} AS category,
      {d.pick(['short', 'medium', 'long', 'permanent'], f'{k} % 4')} AS memory_type,
      {d.pick(['conversation', 'document', 'nudge'], f'{k} % 3')} AS source,
      {d.stamp('ts')} AS created_at,
      CASE WHEN {k} % 3 = 0 THEN NULL ELSE {d.stamp(d.seconds('ts', f'{k} % 5000'))} END AS last_accessed_at,
      {d.int(f'{k} % 5')} AS access_count, {k} % 11 <> 0 AS is_active
    FROM {d.t('events')}
    """


@shape("events")
def member_facts(d):
    """Append-versioned personal and household facts."""
    k = "event_id"
    key = "CASE event_type WHEN 'click' THEN 'birth_date' WHEN 'view' THEN 'id_number' WHEN 'purchase' THEN 'financial_salary' WHEN 'error' THEN 'health_note' ELSE 'spouse' END"
    return f"""
    SELECT event_id AS fact_id,
      CASE WHEN {k} % 5 = 0 THEN NULL ELSE user_id END AS subject_member_id,
      CASE WHEN {k} % 5 = 0 THEN concat('house ', {d.text('user_id % 9')}) ELSE NULL END AS location_key,
      CASE WHEN {k} % 5 = 0 THEN 'building_code' ELSE {key} END AS fact_key,
      CASE WHEN event_type = 'signup' AND {k} % 5 <> 0 THEN concat('Customer#', {d.lpad('(user_id * 7) % 150', 9)}) ELSE {d.text('1000 + ' + k)} END AS fact_value,
      {d.stamp('ts')} AS created_at, {k} % 6 <> 0 AS is_active
    FROM {d.t('events')}
    """


@shape("orders")
def bills(d):
    """Utility-bill texts (electricity, water, unknown issuer) with the values they were written from."""
    k = "o_orderkey"
    nl = d.nl
    day = "cast(o_orderdate as date)"
    account, bill = f"377000000 + {k}", f"55000000 + {k}"
    power = f"""concat('עם חשמל ירוק', {nl}, 'מספר צרכן אלקטרה פאוור: ', {d.text(account)}, {nl}, 'צריכה מאלקטרה', {nl},
        'חשבונית מס/קבלה (מקור) ', {d.text(bill)}, {nl}, 'תאריך עריכת החשבון: ', {d.dmy(day)}, {nl},
        'חשבון לתקופה: ', {d.dmy(d.days(day, '-1'))}, ' ', {d.dmy(d.days(day, '-32'))}, {nl},
        'סה"כ כולל מע"מ ', {d.commas('o_totalprice')}, {nl}, 'מועד התשלום בתאריך ', {d.dmy(d.days(day, '14'))}, {nl},
        'מסלול התחשבנות: ביתי ', {d.text(f'{k} % 5')}, {nl}, 'מספר חשבון חוזה ', {d.text(f'9000 + {k}')})"""
    water = f"""concat('מי רעננה', {nl}, 'שירותי מים וביוב', {nl}, 'מספר משלם: ', {d.text(account)}, {nl},
        'מספר הספח/חשבונית ', {d.text(bill)}, {nl}, 'תאריך הוצאת החשבון ', {d.dmy(day)}, {nl},
        'לתקופה ', {d.dmy(d.days(day, '-32'))}, ' - ', {d.dmy(d.days(day, '-1'))}, {nl},
        'כמות המים לחיוב ', {d.text(f'{k} % 90')}, '.5 מ"ק', {nl}, 'מספר נפשות מוכר ', {d.text(f'1 + {k} % 6')}, {nl},
        'סוג שימוש: מגורים', {nl}, 'תאריך אחרון לתשלום ', {d.dmy(d.days(day, '14'))})"""
    other = f"concat('Quarterly bill', {nl}, 'consumer number: ', {d.text(account)}, {nl}, 'issue date: ', {d.dots(day)})"
    return f"""
    SELECT o_orderkey AS doc_id, o_custkey % 20 AS uploaded_by, {d.pick(SOURCES, f'{k} % 6')} AS source,
      concat({d.text(bill)}, '.v2.pdf') AS filename,
      CASE {k} % 4 WHEN 0 THEN {power} WHEN 1 THEN {water} WHEN 2 THEN concat({power}, {nl}, {water}) ELSE {other} END AS raw_text,
      CASE {k} % 4 WHEN 1 THEN 'water' WHEN 3 THEN NULL ELSE 'electricity' END AS true_service,
      {d.text(account)} AS true_account, {d.text(bill)} AS true_bill, {day} AS true_issue_date,
      {d.days(day, '-32')} AS true_start, {d.days(day, '-1')} AS true_end, {d.days(day, '14')} AS true_due,
      cast(o_totalprice as decimal(18,2)) AS true_total, {k} % 90 AS cubic, 1 + {k} % 6 AS people, {k} % 5 AS plan, 9000 + {k} AS contract_no
    FROM {d.t('orders')}
    """


@shape("orders", "customer")
def slips(d):
    """Salary-slip texts, two model answers each (some weak, broken or empty) and the values behind them."""
    k = "o_orderkey"
    nl = d.nl
    pay_month = f"CASE {k} % 4 WHEN 0 THEN {d.iso('o_orderdate')} WHEN 1 THEN concat({d.lpad('month(o_orderdate)', 2)}, '/', {d.text('year(o_orderdate)')}) ELSE concat({d.text('year(o_orderdate)')}, '-', {d.lpad('month(o_orderdate)', 2)}) END"
    gross, net = d.money_text("o_totalprice"), f"concat({d.text('cast(floor(o_totalprice) as bigint)')}, '.5')"

    def answer(conf, with_net):
        net_part = f"', \"net_salary\": ', {net}" if with_net else "', \"net_salary\": null'"
        return f"""concat('Here it is: {d.lb}"employee_name": " ', c_name, ' ", "employer_name": "Employer ', {d.text(f'{k} % 40')},
            '", "pay_month": "', {pay_month}, '", "gross_salary": ', {gross}, {net_part}, ', "income_tax": "', {d.text(f'{k} % 3000')},
            '", "health_tax": "unknown", "confidence": ', {conf}, '{d.rb} done')"""

    return f"""
    SELECT o_orderkey AS doc_id, o_custkey % 20 AS uploaded_by, {d.pick(SOURCES, f'{k} % 6')} AS source,
      CASE WHEN {k} % 3 = 0 THEN NULL ELSE concat('Vendor ', {d.text(f'{k} % 9')}) END AS vendor,
      concat('תלוש שכר', {nl}, 'מספר זהות', {nl}, {d.text(f'20000000 + {k}')}, {nl}, 'מחלקה: ', {d.text(f'{k} % 77')}, {nl},
        'התחלת עבודה', {nl}, {d.dmy('o_orderdate')}, {nl}, 'אחוז משרה ', {d.text(f'{k} % 100')}, '%', {nl},
        'ברוטו למס הכנסה ', {d.text(f'{k} % 30000')}, {nl}, 'הפניקס פנסיה') AS raw_text,
      CASE {k} % 7 WHEN 0 THEN 'no json here' WHEN 1 THEN '{d.lb}"gross_salary": 12, "confidence"' WHEN 2 THEN {answer("'0.4'", True)} WHEN 3 THEN {answer("'1.7'", False)} ELSE {answer("'0.8'", True)} END AS first_answer,
      CASE {k} % 5 WHEN 0 THEN '' WHEN 1 THEN {answer("'0.9'", True)} ELSE {answer("'0.5'", False)} END AS second_answer,
      {pay_month} AS true_pay_month, c_name AS true_employee, concat('Employer ', {d.text(f'{k} % 40')}) AS true_employer,
      cast(o_totalprice as double) AS true_gross, cast({net} as double) AS true_net, cast({k} % 3000 as double) AS true_tax,
      year(o_orderdate) AS true_year, month(o_orderdate) AS true_month, cast(o_orderdate as date) AS true_start
    FROM {d.t('orders')} JOIN {d.t('customer')} ON o_custkey = c_custkey
    """


@shape("orders")
def class_answers(d):
    """Model answers to a classification request, a third of them unusable."""
    k = "o_orderkey"
    body = f"""concat('Sure. {d.lb}"category": "', {d.pick(rules.CATEGORIES + ['poem'], f'{k} % 14')}, '", "confidence": ', {d.text(f'cast({k} % 10 as double) / 10')}, '{d.rb}')"""
    return f"""
    SELECT o_orderkey AS doc_id,
      CASE {k} % 6 WHEN 0 THEN 'cannot tell' WHEN 1 THEN '{d.lb}"category": contract{d.rb}' ELSE {body} END AS answer,
      {d.pick(rules.CATEGORIES + ['poem'], f'{k} % 14')} AS true_category, cast({k} % 10 as double) / 10 AS true_confidence
    FROM {d.t('orders')}
    """


@shape("orders")
def requests(d):
    """Read requests against the catalog: an agent role, a table, a level, and a caller's phone."""
    k = "o_orderkey"
    return f"""
    SELECT o_orderkey AS request_id,
      {d.pick(['librarian', 'finance_agent', 'insurance_agent', 'orchestrator', 'stranger'], 'o_custkey % 5')} AS role,
      {d.pick(['documents', 'document_facts', 'salary_slips', 'utility_bills', 'contracts', 'insurance_policies', 'tasks', 'memories', 'family_members', 'conversations'], f'{k} % 10')} AS table_name,
      {d.pick(['metadata', 'read', 'write', 'read_write', 'none'], 'o_custkey % 7 % 5')} AS required,
      CASE {k} % 3 WHEN 0 THEN concat('9725', {d.lpad(f'{k} % 1300', 8)}, '@c.us') WHEN 1 THEN concat('05', {d.lpad(f'{k} % 1300', 8)}) ELSE concat('+972-5', {d.lpad(f'{k} % 1300', 8)}) END AS phone,
      {d.pick(['finance', 'documents', 'tasks'], 'o_custkey % 3')} AS resource,
      {d.pick(['read', 'write'], f'{k} % 2')} AS action,
      CASE WHEN {k} % 4 = 0 THEN concat('  CUSTOMER#', {d.lpad('o_custkey', 9)}, ' ') WHEN {k} % 4 = 1 THEN concat('ל', 'customer#', {d.lpad('o_custkey', 9)}) WHEN {k} % 4 = 2 THEN {d.lpad('o_custkey', 5)} ELSE 'nobody' END AS person
    FROM {d.t('orders')}
    """


@shape("orders")
def notes(d):
    """Short free texts per order for the statement parsers, with the values they state."""
    k = "o_orderkey"
    day = "cast(o_orderdate as date)"
    n = d.text(k)
    return f"""
    SELECT o_orderkey AS note_id,
      CASE {k} % 4 WHEN 0 THEN concat(' לדנה', {n}, ' - Fix door ', {n}, ' ') WHEN 1 THEN concat('עבור  Noa', {n}, ': call') WHEN 2 THEN concat('Buy milk ', {n}) ELSE 'לא' END AS title,
      CASE {k} % 5 WHEN 0 THEN concat('עד ', {d.iso(day)}, ' דחוף') WHEN 1 THEN concat('title Paint wall ', {n}, ' due ', {d.iso(day)}, ' LOW') WHEN 2 THEN 'priority normal, high' WHEN 3 THEN concat('כותרת שם ', {n}) ELSE 'nothing to change' END AS changes,
      CASE {k} % 5 WHEN 0 THEN concat('ארנונה ', {n}, ', חודשי, ', {d.text(f'1 + {k} % 31')}) WHEN 1 THEN concat('gym ', {n}, ' , שבועי') WHEN 2 THEN concat('rent ב-', {d.text(f'1 + {k} % 28')}, ' בחודש') WHEN 3 THEN concat('tax ', {n}, ', שנתי, soon') ELSE concat('walk ', {n}, ', often') END AS recurring,
      CASE {k} % 6 WHEN 0 THEN concat('Dana', {n}, ' was born on ', {d.dmy(day)}) WHEN 1 THEN concat('יוסי נולד ב ', {d.dots(day)}) WHEN 2 THEN concat('Noa', {n}, ' id number: ', {d.text(f'200000 + {k}')}) WHEN 3 THEN concat('Ahuza ', {n}, ' building code is ', {d.text(f'1000 + {k}')}) WHEN 4 THEN concat('קוד בניין של רחוב הרצל: ', {d.text(f'1000 + {k}')}) ELSE 'nothing stated' END AS statement,
      CASE {k} % 4 WHEN 0 THEN concat(' ', {n}, ' ') WHEN 1 THEN concat({n}, 'x') WHEN 2 THEN '' ELSE concat({n}, '.0') END AS number_text,
      {day} AS day, {k} % 2 = 0 AS flag
    FROM {d.t('orders')}
    """
