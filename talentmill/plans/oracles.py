"""The same queries in plain SQL (DuckDB dialect), for comparing results.

Written against the supplied tables alone and formulated independently where a rule
allows it: naive joins instead of weighted ones, one regex test per term instead of
token lookup, all pairs instead of a pruned search.
"""

from __future__ import annotations

from ..functions import vocab
from ..operators import seed
from ..operators.events import EVENT_FIELDS, EVENT_SCHEMA
from ..schemas import STAGES, TABLES
from ..sources import star_views as v
from .queries import (
    AS_OF, AS_OF_YEAR, LEAK_THRESHOLD, NEIGHBOUR_THRESHOLD, PAIR_THRESHOLD, STREAM_DIM,
)

ORACLES: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(x) for x in values) + "]"


def pick(key: str, values) -> str:
    return f"({items(values)})[(({key}) % {len(values)}) + 1]"


def choose(key: str, values: dict[int, str], mod: int) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(x)}" for k, x in values.items())
    return f"CASE {key} % {mod} {whens} END"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def text_list(x: str) -> str:
    return f"array_to_string({x}, '|')"


def after_2024(key: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_days(CAST({key} % 365 AS INTEGER))"


PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
PAY = f"({PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2))))"
RATES = """CAST(bill AS DOUBLE) AS bill_rate, CAST(pay AS DOUBLE) AS pay_rate, CAST(bill - pay AS DOUBLE) AS margin"""


def lines(*keys: str) -> str:
    """Order lines summed per key, and the largest line as `l`."""
    k = ", ".join(keys)
    return f"""(SELECT {k}, sum({PRICE}) AS bill, sum({PAY}) AS pay, sum(l_quantity) AS hours, max(l_shipdate) AS shipped,
        max({{'price': l_extendedprice, 'supp': l_suppkey, 'part': l_partkey, 'line': l_linestatus, 'back': l_returnflag}}) AS l
        FROM lineitem GROUP BY {k})"""


VIEWS = {
    "clients": f"""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry,
        'Contact ' || c_custkey AS contact_name, 'contact' || c_custkey || '@example.com' AS contact_email,
        CASE WHEN c_acctbal < 0 THEN 'churned' WHEN c_custkey % 10 = 0 THEN 'inactive' ELSE 'active' END AS status,
        c_nationkey AS req_volume, c_acctbal / 100 AS margin_pct, {after_2024('c_custkey')} AS created_at
        FROM customer""",
    "recruiters": f"""SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
        lower(n_name) || '@example.com' AS email, r_name AS team, {after_2024('n_nationkey')} AS created_at
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "candidates": f"""SELECT s_suppkey AS id, s_name AS name, 's' || s_suppkey || '@example.com' AS email,
        {items(v.SKILL_POOL)} AS pool,
        [pool[s_suppkey % 10 + 1], pool[(s_suppkey * 3 + 1) % 10 + 1], pool[(s_suppkey * 7 + 2) % 10 + 1],
         pool[(s_suppkey // 10) % 10 + 1]] AS s4,
        list_filter(s4, lambda x, i: list_position(s4, x) = i) AS skills,
        {pick('s_suppkey', v.VISA_CYCLE)} AS visa_status, 'NATION_' || s_nationkey AS location,
        CAST(s_suppkey % 16 AS DOUBLE) AS yoe, s_acctbal AS rate, 'resumes/' || s_suppkey || '.pdf' AS resume_path,
        CASE s_suppkey % 5 WHEN 2 THEN NULL WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS is_active_contractor,
        CASE WHEN is_active_contractor THEN s_suppkey * 37 % 720 END AS tenure_days,
        CASE WHEN is_active_contractor THEN s_suppkey * 11 % 31 END AS comms_gap_days,
        CASE WHEN is_active_contractor THEN CAST(s_suppkey * 7 % 26 AS DOUBLE) END AS overtime_pct,
        CASE WHEN is_active_contractor THEN CAST(s_suppkey % 6 AS DOUBLE) END AS client_feedback_score,
        CAST(NULL AS DOUBLE) AS attrition_risk_score, {after_2024('s_suppkey')} AS created_at
        FROM supplier""",
    "jobs": f"""SELECT p_partkey AS id, p_name AS title, p_partkey % (SELECT count(*) FROM customer) AS client_id,
        'We need a ' || p_name || ' for ' || p_type || ' work.' AS jd_text, {items(v.SKILL_POOL)} AS pool,
        [pool[p_partkey % 10 + 1], pool[(p_partkey * 3 + 2) % 10 + 1], pool[(p_partkey // 7) % 10 + 1]] AS s3,
        list_filter(s3, lambda x, i: list_position(s3, x) = i) AS required_skills,
        'NATION_' || (p_partkey % 25) AS location, p_size % 3 = 0 AS remote_ok, p_retailprice AS rate_min,
        p_retailprice * 1.5::DOUBLE AS rate_max,
        CASE WHEN p_partkey % 10 >= 7 THEN 'citizen' END AS visa_requirement,
        CAST(p_size % 8 AS DOUBLE) AS min_yoe, CAST(p_size % 8 + 6 AS DOUBLE) AS max_yoe,
        {pick('p_partkey', v.JOB_STATUS_CYCLE)} AS status, {after_2024('p_partkey')} AS created_at
        FROM part""",
    "placements": f"""SELECT o_orderkey AS id, l.supp AS candidate_id, l.part AS job_id,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 25 END AS recruiter_id, o_custkey AS client_id,
        CASE WHEN o_orderstatus = 'O' THEN 'submitted'
             WHEN o_orderstatus = 'P' AND l.line = 'O' THEN 'interview' WHEN o_orderstatus = 'P' THEN 'offer'
             WHEN l.back = 'R' THEN 'rejected' ELSE 'hire' END AS stage,
        CAST(NULL AS DOUBLE) AS match_score, CAST(NULL AS VARCHAR) AS skill_gap, {RATES},
        o_orderdate AS submitted_at, o_orderdate AS updated_at
        FROM {lines('l_orderkey')} JOIN orders ON l_orderkey = o_orderkey""",
    "payroll": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l.supp AS contractor_id,
        CAST(shipped AS DATE) AS period, {RATES},
        CAST(bill - pay AS DOUBLE) / CAST(bill AS DOUBLE) * 100 AS margin_pct, shipped AS created_at
        FROM {lines('l_orderkey', 'l_linenumber')}""",
    "timesheets": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l.supp AS contractor_id,
        CAST(date_trunc('week', shipped) AS DATE) AS week_start, hours,
        greatest(hours - 40, 0.0::DOUBLE) AS overtime_hours,
        CASE WHEN hours > 48 THEN 'flagged' ELSE 'approved' END AS status,
        CASE WHEN l_linenumber <> 7 THEN hours > 48 END AS anomaly_flag,
        CASE WHEN hours > 48 THEN hours / 64 END AS anomaly_score,
        CASE WHEN hours > 48 THEN 'hours beyond a usual week' END AS anomaly_reason,
        shipped AS created_at FROM {lines('l_orderkey', 'l_linenumber')}""",
    "predictions": f"""SELECT event_id AS id, {pick('user_id', v.ENTITY_CYCLE)} AS entity_type, user_id AS entity_id,
        event_type AS model_name, value AS score, props AS features,
        CASE WHEN event_id % 50 <> 0 THEN ts END AS created_at FROM events""",
    "resumes": f"""SELECT doc_id, source, concat_ws(chr(10),
        {choose('doc_id', {0: 'Jane Doe', 1: 'Omar Ali Khan', 2: 'Müller, André', 3: 'José García', 4: ''}, 5)},
        CASE WHEN doc_id % 3 = 0 THEN 'User.' || doc_id || '+cv@Example.CO.UK' END,
        {choose('doc_id', {0: '(555) 123-4567', 1: '555.987.6543'}, 4)},
        {choose('doc_id', {0: 'US Citizen', 1: 'Green Card holder', 2: 'H-1B visa', 3: 'F1 OPT',
                           4: 'STEM OPT extension', 5: 'EAD card', 6: 'Team lead, F1 OPT'}, 8)},
        {choose('doc_id', {0: 'Jan 2018 - Dec 2021' + chr(10) + 'Jan 2022 - Present', 1: '2018 - 2022, 2020 - 2024',
                           2: '10+ years of experience', 3: '2020 - 2020, 2019 - 2023', 4: '2019 — 2023'}, 6)},
        {choose('doc_id', {0: 'Python, AWS, k8s and Node.js', 1: 'ReactJS; scikit-learn; SQL',
                           2: 'C# and .NET, asp.net', 3: 'épython, go-getter, ML, CV',
                           4: 'CI/CD, GitHub Actions, Power BI', 5: 'Apache Spark, Apache Kafka, PostgreSQL'}, 7)},
        text) AS text FROM documents""",
    "resume_files": f"""SELECT CASE WHEN doc_id % 7 = 0 THEN 'resumes/old' ELSE 'resumes' END || '/cv ' || doc_id || '.'
        || {pick('doc_id', ('pdf', 'docx', 'doc', 'PDF', 'txt', 'png'))} AS path, doc_id,
        CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(10) || chr(9) || ' ' ELSE text END AS text,
        lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS file_type FROM documents""",
    "timings": """SELECT event_type AS operation, value AS ms FROM events
        UNION ALL SELECT 'user_' || user_id || '_' || event_type, value FROM events""",
    "fields": f"""SELECT event_id, ts, value * 8 AS took,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS level,
        {pick('event_id', ('embed took 1200ms', 'db_query', 'Slow parse', 'TIMEOUT on fetch', 'ok', 'done'))} AS msg,
        CAST(user_id AS VARCHAR) AS request_id,
        CASE event_type {' '.join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in v.KIND_OF_EVENT.items())} END AS event,
        CASE WHEN event_type = 'error' THEN 'timeout' END AS error, user_id FROM events""",
}

def add(name: str, views: str, sql: str) -> None:
    """Register a query over the named views; sql may start with further WITH parts."""
    parts = [f"{x} AS ({VIEWS[x]})" for x in views.split()]
    sql = sql.strip()
    if sql.startswith("WITH "):
        parts.append(sql[5:])
        ORACLES[name] = "WITH " + ",\n".join(parts)
    else:
        ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


# Scans and lookups

CANDIDATE_OUT = f"""id, name, email, {text_list('skills')} AS skills, visa_status, location, yoe, rate,
    is_active_contractor, attrition_risk_score, resume_path, {ts('created_at')} AS created_at"""
JOB_OUT = f"""id, title, client_id, {text_list('required_skills')} AS required_skills, location, remote_ok, rate_min,
    rate_max, visa_requirement, min_yoe, max_yoe, status, {ts('created_at')} AS created_at"""
CLIENT_OUT = f"""id, name, industry, status, req_volume, margin_pct, contact_name, contact_email,
    {ts('created_at')} AS created_at"""

add("scan_candidates", "candidates", f"SELECT {CANDIDATE_OUT} FROM candidates WHERE is_active_contractor IS TRUE")
add("scan_jobs", "jobs", f"SELECT {JOB_OUT} FROM jobs")
add("open_jobs", "jobs", f"SELECT {JOB_OUT} FROM jobs WHERE status = 'open'")
add("scan_clients", "clients", f"SELECT {CLIENT_OUT} FROM clients")
add("scan_recruiters", "recruiters", f"SELECT id, name, email, team, {ts('created_at')} AS created_at FROM recruiters")
add("placements_filtered", "placements", f"""
    SELECT id, candidate_id, job_id, recruiter_id, client_id, stage, match_score, skill_gap, bill_rate, pay_rate,
           margin, {ts('submitted_at')} AS submitted_at, {ts('updated_at')} AS updated_at
    FROM placements WHERE recruiter_id = 0 AND stage = 'hire'""")
add("timesheets_flagged", "timesheets", f"""
    SELECT id, contractor_id, {day('week_start')} AS week_start, hours, overtime_hours, status, anomaly_flag,
           anomaly_score, anomaly_reason, {ts('created_at')} AS created_at
    FROM timesheets WHERE anomaly_flag IS TRUE""")
add("payroll_by_contractor", "payroll", f"""
    SELECT id, contractor_id, {day('period')} AS period, bill_rate, pay_rate, margin, margin_pct,
           {ts('created_at')} AS created_at
    FROM payroll WHERE contractor_id = 0""")
add("predictions_history", "predictions", f"""
    SELECT id, entity_type, entity_id, model_name, score, features, {ts('created_at')} AS created_at
    FROM predictions WHERE model_name = 'error' AND entity_type = 'client' ORDER BY predictions.created_at DESC NULLS FIRST""")
add("latest_prediction_per_entity", "predictions", f"""
    SELECT id, entity_type, entity_id, model_name, score, features, {ts('created_at')} AS created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, model_name ORDER BY created_at DESC, id DESC) AS rn
        FROM predictions WHERE created_at IS NOT NULL) WHERE rn = 1""")
add("lookup_by_keys", "clients", f"""
    SELECT {CLIENT_OUT} FROM clients WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
add("missing_keys", "", """
    SELECT DISTINCT o_custkey * 2 AS id FROM orders
    WHERE o_totalprice > 450000 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2)""")

# Aggregates and joins

add("funnel_counts", "placements", "SELECT stage, count(id) AS count FROM placements GROUP BY stage")
add("funnel_counts_client", "placements",
    "SELECT stage, count(id) AS count FROM placements WHERE client_id = 65 GROUP BY stage")
add("monthly_revenue", "payroll", f"""
    SELECT {day("date_trunc('month', period)")} AS month,
           CAST(sum(CAST(bill_rate AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(contractor_id) AS headcount
    FROM payroll GROUP BY date_trunc('month', period) ORDER BY 1""")
add("monthly_headcount_distinct", "payroll", f"""
    SELECT {day("date_trunc('month', period)")} AS month, count(DISTINCT contractor_id) AS contractors
    FROM payroll GROUP BY date_trunc('month', period)""")
add("margin_leakage_clients", "clients", "SELECT id, name, margin_pct FROM clients WHERE margin_pct < 15")


def leakage(source: str) -> str:
    average = "CAST(sum(CAST(p.margin_pct AS DECIMAL(18,2))) AS DOUBLE) / count(p.margin_pct)"
    return f"""
    SELECT c.id, c.name, {average} AS avg_margin_pct,
           CAST(sum(CAST(p.bill_rate AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM payroll p JOIN candidates k ON k.id = p.contractor_id JOIN {source} x ON x.candidate_id = k.id
    JOIN clients c ON c.id = x.client_id
    GROUP BY c.id, c.name HAVING {average} < {LEAK_THRESHOLD}::DOUBLE"""


add("margin_leakage_fanout", "payroll candidates placements clients", leakage("placements"))
add("margin_leakage_dedup", "payroll candidates placements clients",
    leakage("(SELECT DISTINCT candidate_id, client_id FROM placements)"))


def rounded(numerator: str, denominator: str, digits: int) -> str:
    """Half-up rounding of a ratio of whole numbers."""
    return f"CAST((2 * {numerator} * {10 ** digits} + {denominator}) // (2 * {denominator}) AS DOUBLE) / {10 ** digits}"


add("op_latency_stats", "timings", f"""
    WITH s AS (SELECT operation, CAST(round(ms * 1000000) AS HUGEINT) AS us FROM timings),
    r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY us) AS rn, count(*) OVER (PARTITION BY operation) AS n FROM s)
    SELECT operation, count(*) AS calls, {rounded('sum(us)', '(1000000 * count(*))', 2)} AS avg_ms,
           {rounded('min(us)', '1000000', 2)} AS min_ms, {rounded('max(us)', '1000000', 2)} AS max_ms,
           {rounded('sum(us)', '1000000000', 3)} AS total_s,
           CASE WHEN count(*) >= 20 THEN {rounded("max(CASE WHEN rn = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1 THEN us END)", '1000000', 2)} END AS p95_ms
    FROM r GROUP BY operation""")
add("active_contractors", "candidates", """
    SELECT count(*) AS candidates, count(*) FILTER (is_active_contractor) AS active_contractors FROM candidates""")
add("placement_detail", "placements candidates jobs clients recruiters", f"""
    SELECT p.id, p.candidate_id, k.name AS candidate, p.job_id, j.title AS job, p.client_id, c.name AS client,
           p.recruiter_id, r.name AS recruiter, p.stage, p.bill_rate, p.pay_rate, p.margin,
           {ts('p.submitted_at')} AS submitted_at
    FROM placements p JOIN candidates k ON k.id = p.candidate_id JOIN jobs j ON j.id = p.job_id
    JOIN clients c ON c.id = p.client_id LEFT JOIN recruiters r ON r.id = p.recruiter_id""")
add("jobs_per_client", "jobs clients", """
    SELECT c.id, count(j.id) AS jobs FROM clients c LEFT JOIN jobs j ON j.client_id = c.id GROUP BY c.id""")
add("timesheets_per_candidate", "timesheets candidates", """
    SELECT k.id, count(t.id) AS timesheets FROM candidates k LEFT JOIN timesheets t ON t.contractor_id = k.id GROUP BY k.id""")

# Derived measures and contracts

# Bill and pay in ten-thousandths; the percentage in tenths rounds half up on whole numbers.
add("margin_calc", "payroll", """
    WITH c AS (SELECT *, CAST(CAST(bill_rate AS DECIMAL(18,4)) * 10000 AS BIGINT) AS b,
                      CAST(CAST(pay_rate AS DECIMAL(18,4)) * 10000 AS BIGINT) AS p FROM payroll)
    SELECT id, contractor_id, bill_rate, pay_rate, (b - p) / 10000.0::DOUBLE AS margin,
           CASE WHEN b <> 0 THEN CAST((2 * (b - p) * 1000 + b) // (2 * b) AS DOUBLE) / 10 END AS margin_pct FROM c""")
add("overtime", "timesheets", """
    SELECT id, contractor_id, hours,
           CAST(round(greatest(CAST(hours * 1.15::DOUBLE AS DECIMAL(18,4)) - 40, 0), 1) AS DOUBLE) AS overtime_hours
    FROM timesheets""")
add("weekly_hours", "timesheets", f"""
    SELECT contractor_id, {day('week_start')} AS week_start, sum(hours) AS hours,
           sum(overtime_hours) AS overtime_hours, count(*) AS sheets
    FROM timesheets GROUP BY contractor_id, week_start""")

CHECKED = {
    "clients": "id name industry contact_name contact_email status",
    "recruiters": "id name email team",
    "candidates": "id name email location resume_path visa_status",
    "jobs": "id title client_id location visa_requirement status",
    "placements": "id candidate_id job_id recruiter_id client_id stage",
    "timesheets": "id contractor_id week_start hours status anomaly_reason",
    "payroll": "id contractor_id period bill_rate pay_rate margin margin_pct",
    "predictions": "id entity_type entity_id model_name score",
}


def violations() -> str:
    out = []

    def rule(table: str, name: str, count: str) -> None:
        out.append(f"SELECT {lit(table)} AS \"table\", {lit(name)} AS rule, CAST(({count}) AS BIGINT) AS violations")

    for name, columns in CHECKED.items():
        t, have = TABLES[name], columns.split()
        rows = {"placements": "faulty_placements", "clients": "faulty_clients"}.get(name, name)
        for c in t.required:
            rule(name, f"{c} not null", f"SELECT count(*) FROM {rows} WHERE {c} IS NULL")
        for c, domain in t.domains.items():
            if c in have:
                rule(name, f"{c} in domain", f"SELECT count(*) FROM {rows} WHERE {c} NOT IN ({', '.join(map(lit, domain))})")
        for c, n in t.max_length.items():
            if c in have:
                rule(name, f"{c} length <= {n}", f"SELECT count(*) FROM {rows} WHERE length({c}) > {n}")
        for c in t.unique:
            if c in have:
                rule(name, f"{c} unique", f"SELECT count({c}) - count(DISTINCT {c}) FROM {rows}")
        for c, parent in t.links.items():
            if c in have and parent in CHECKED:
                rule(name, f"{c} in {parent}",
                     f"SELECT count(*) FROM {rows} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {parent})")
    return "\nUNION ALL ".join(out)


add("contract_violations", " ".join(CHECKED), f"""
    WITH faulty_placements AS (SELECT * REPLACE (
        CASE WHEN id % 17 = 0 THEN 'lost' ELSE stage END AS stage,
        CASE WHEN id % 19 = 0 THEN -1 ELSE job_id END AS job_id,
        CASE WHEN id % 23 <> 0 THEN client_id END AS client_id) FROM placements),
    faulty_clients AS (SELECT * REPLACE (CASE WHEN id % 29 = 0 THEN repeat(name, 20) ELSE name END AS name) FROM clients)
    {violations()}""")

# Text rules

WS_SQL = "".join(f"\\x{{{ord(c):x}}}" for c in vocab.WS_CHARS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')"


def email_of(t: str) -> str:
    return f"lower(nullif(regexp_extract({t}, {lit(vocab.EMAIL)}), ''))"


def phone_of(t: str) -> str:
    return strip(f"nullif(regexp_extract({t}, {lit(vocab.PHONE)}), '')")


def name_of(t: str) -> str:
    lines = f"list_transform(string_split({t}, chr(10))[1:5], lambda line: {strip('line')})"
    return f"list_filter({lines}, lambda line: regexp_matches(line, {lit(vocab.NAME_LINE)}))[1]"


def skills_of(lowered: str) -> str:
    tests = ",\n".join(
        f"CASE WHEN regexp_matches({lowered}, {lit(vocab.bounded(term))}) THEN {lit(label)} END"
        for term, label in vocab.skill_terms().items()
    )
    return f"list_sort(list_distinct(list_filter([{tests}], lambda x: x IS NOT NULL)))"


def visa_of(lowered: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({lowered}, {lit(k)})' for k in vocab.VISA_KEYWORDS[s])} THEN {lit(s)}"
        for s in vocab.VISA_PRIORITY
    )
    return f"CASE {whens} ELSE 'unknown' END"


def spans_of(t: str) -> str:
    """Plausible year ranges of a text in document order, as structs s, e."""
    p = lit("(?i)" + vocab.MONTH + vocab.YEAR_RANGE.removeprefix("(?i)"))
    pairs = f"list_zip(regexp_extract_all({t}, {p}, 1), regexp_extract_all({t}, {p}, 2))"
    spans = f"""list_transform({pairs}, lambda z: {{'s': CAST(z[1] AS INT),
        'e': CASE WHEN lower(z[2]) IN ('present', 'current', 'now') THEN {AS_OF_YEAR} ELSE TRY_CAST(z[2] AS INT) END}})"""
    return f"""list_filter({spans}, lambda r: r.s BETWEEN {vocab.FIRST_YEAR} AND {AS_OF_YEAR}
        AND r.s <= r.e AND r.e <= {AS_OF_YEAR} + 1)"""


def yoe_of(spans: str, t: str) -> str:
    kept = f"""list_reduce(list_transform({spans}, lambda r: [r]), lambda acc, r:
        CASE WHEN len(list_filter(acc, lambda k: NOT (r[1].e <= k.s OR r[1].s >= k.e))) > 0 THEN acc
             ELSE list_concat(acc, r) END)"""
    years = f"CASE WHEN len({spans}) = 0 THEN 0 ELSE list_sum(list_transform({kept}, lambda r: r.e - r.s)) END"
    stated = f"TRY_CAST(nullif(regexp_extract({t}, {lit(vocab.YEARS_STATED)}, 1), '') AS DOUBLE)"
    return f"CASE WHEN {years} > 0 THEN CAST({years} AS DOUBLE) ELSE coalesce({stated}, 0.0::DOUBLE) END"


add("extract_email", "resumes", f"SELECT doc_id, {email_of('text')} AS email FROM resumes")
add("extract_phone", "resumes", f"SELECT doc_id, {phone_of('text')} AS phone FROM resumes")
add("extract_name", "resumes", f"SELECT doc_id, {name_of('text')} AS name FROM resumes")
add("extract_skills", "resumes", f"""
    WITH r AS (SELECT doc_id, lower(text) AS l FROM resumes)
    SELECT doc_id, {text_list(skills_of('l'))} AS skills FROM r""")
add("extract_yoe", "resumes", f"""
    WITH r AS MATERIALIZED (SELECT doc_id, text, {spans_of('text')} AS spans FROM resumes)
    SELECT doc_id, {yoe_of('spans', 'text')} AS yoe FROM r""")
add("extract_visa", "resumes", f"""
    WITH r AS (SELECT doc_id, lower(text) AS l FROM resumes) SELECT doc_id, {visa_of('l')} AS visa_status FROM r""")
ALIAS_ROWS = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in vocab.SKILL_ALIASES.items())
add("normalise_skill", "resumes", f"""
    WITH alias(term, label) AS (VALUES {ALIAS_ROWS}),
    r AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[,;\\n]')) AS raw FROM resumes)
    SELECT doc_id, raw, coalesce(label, array_to_string(list_transform(
        regexp_extract_all(raw, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: CASE x[1:1] WHEN 'ß' THEN 'Ss' ELSE upper(x[1:1]) END || lower(x[2:])), '')) AS skill
    FROM r LEFT JOIN alias ON term = {strip('lower(raw)')}""")
add("skill_frequency", "resumes", f"""
    WITH r AS (SELECT doc_id, lower(text) AS l FROM resumes), s AS (SELECT unnest({skills_of('l')}) AS skill FROM r)
    SELECT skill, count(*) AS resumes FROM s GROUP BY skill""")


def parsed(source: str) -> str:
    """WITH parts: parsed rows (p) of a source with a text column."""
    return f"""r AS MATERIALIZED (SELECT *, lower(text) AS l, {spans_of('text')} AS spans,
            NOT regexp_matches(text, '[^{WS_SQL}]') AS blank FROM {source}),
    p AS MATERIALIZED (SELECT *, coalesce({name_of('text')}, 'Unknown') AS name, {email_of('text')} AS email, {phone_of('text')} AS phone,
            {skills_of('l')} AS skills, {yoe_of('spans', 'text')} AS yoe, {visa_of('l')} AS visa_status FROM r)"""


def unless_blank(x: str, alias: str) -> str:
    return f"CASE WHEN NOT blank THEN {x} END AS {alias}"


add("parse_documents", "resumes", f"""
    WITH b AS (SELECT * REPLACE (CASE WHEN doc_id % 50 = 49 THEN ' ' || chr(10) || chr(9) ELSE text END AS text) FROM resumes),
    {parsed('b')}
    SELECT doc_id, {unless_blank('name', 'name')}, {unless_blank('email', 'email')}, {unless_blank('phone', 'phone')},
           {unless_blank(text_list('skills'), 'skills')}, {unless_blank('yoe', 'yoe')},
           {unless_blank('visa_status', 'visa_status')},
           CASE WHEN blank THEN 'rejected' ELSE 'parsed' END AS status, CASE WHEN blank THEN 'no text' END AS error FROM p""")
add("candidate_embed_text", "resumes", f"""
    WITH {parsed('resumes')}
    SELECT doc_id, concat_ws(chr(10), CASE WHEN text <> '' THEN text END,
        CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END,
        CASE WHEN source <> '' THEN 'Location: ' || source END,
        CASE WHEN visa_status <> '' THEN 'Visa: ' || visa_status END,
        CASE WHEN yoe <> 0 THEN 'Years of experience: ' || CAST(yoe AS VARCHAR) END) AS embed_text FROM p""")
JOB_TEXT = """concat_ws(chr(10), 'Job title: ' || title, jd_text,
        'Required skills: ' || array_to_string(required_skills, ', '), 'Location: ' || location,
        CASE WHEN min_yoe <> 0 THEN 'Minimum experience: ' || CAST(min_yoe AS VARCHAR) || ' years' END)"""
add("job_embed_text", "jobs", f"SELECT id, {JOB_TEXT} AS embed_text FROM jobs")
add("truncate_text", "resumes", """
    WITH h AS (SELECT doc_id, text, substring(text, 1, 800) AS head FROM resumes),
    d AS (SELECT *, list_max(list_filter(range(1, 801), lambda i: substring(head, i, 1) = '.')) AS dot FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 800 THEN text WHEN dot - 1 > 640 THEN substring(head, 1, dot) ELSE head END AS cut
    FROM d""")
add("safe_filename", "resume_files", """
    SELECT path, '20260601_120000_' || regexp_replace(path, '[^A-Za-z0-9_.-]', '_', 'g') AS stored_as FROM resume_files""")
DECODER = "CASE WHEN file_type = 'pdf' THEN 'pdf' WHEN file_type IN ('docx', 'doc') THEN 'docx' END"
add("route_by_type", "resume_files", f"""
    SELECT path, file_type, {DECODER} AS decoder,
           CASE WHEN {DECODER} IS NULL THEN 'unsupported file type: ' || file_type END AS error FROM resume_files""")
add("resume_files_listed", "resume_files", """
    SELECT path FROM resume_files WHERE file_type IN ('pdf', 'docx', 'doc') AND regexp_matches(path, '^resumes/[^/]+$')""")
OUTCOME = f"""CASE WHEN {DECODER} IS NULL THEN 'unsupported' WHEN NOT regexp_matches(text, '[^{WS_SQL}]') THEN 'rejected'
    ELSE 'parsed' END"""
add("parse_outcomes", "resume_files", f"""
    SELECT {OUTCOME} AS status, count(*) AS files FROM resume_files GROUP BY 1""")

STORED = """stored AS (SELECT *, doc_id % 11 = 0 AS broken, regexp_extract(path, '([^/]+)$', 1) AS file,
        regexp_matches(path, '^resumes/[^/]+$') AS direct, CASE WHEN doc_id % 11 = 0 THEN unhex('FF') || encode(text) ELSE encode(text) END AS content
    FROM resume_files WHERE text IS NOT NULL AND (doc_id % 11 = 0 OR text <> ''))"""
add("stored_files_listed", "resume_files", f"""
    WITH {STORED} SELECT file, octet_length(content) AS length FROM stored WHERE direct AND file_type IN ('pdf', 'docx', 'doc')""")
add("stored_files_loaded", "resume_files", f"""
    WITH {STORED} SELECT file, octet_length(content) AS length, md5(content) AS digest FROM stored""")
add("stream_files", "resume_files", f"""
    WITH {STORED}, kept AS (SELECT * FROM stored WHERE direct AND file_type IN ('pdf', 'docx', 'doc')), {parsed('kept')}
    SELECT file, CASE WHEN broken THEN 'failed' WHEN blank THEN 'rejected' ELSE 'parsed' END AS status,
           CASE WHEN broken THEN 'UnicodeDecodeError' WHEN blank THEN 'no text' END AS problem,
           CASE WHEN NOT broken AND NOT blank THEN email END AS email, CASE WHEN NOT broken AND NOT blank THEN yoe END AS yoe,
           CASE WHEN NOT broken AND NOT blank THEN visa_status END AS visa_status,
           CASE WHEN NOT broken AND NOT blank THEN {text_list('skills')} END AS skills,
           CASE WHEN NOT broken THEN md5(text) END AS digest FROM p""")

# Event logs


def typed_fields() -> str:
    values = {
        "level": "CASE WHEN event <> 'db_query' THEN 'INFO' WHEN took > 500 THEN 'WARNING' ELSE 'DEBUG' END",
        "msg": "event", "request_id": "request_id", "event": "event", "ts": ts("ts"),
        "duration_ms": "CAST(CAST(took AS DECIMAL(18,2)) AS DOUBLE)", "slow": "took > 500",
        "score": "(event_id % 10000) / 10000.0::DOUBLE", "candidate_id": "user_id", "file_type": "'pdf'",
        "skills_found": "event_id % 12", "yoe": "CAST(event_id % 20 AS DOUBLE)",
        "visa_status": pick("user_id", v.VISA_CYCLE), "success": "event_id % 9 <> 0", "error": "error",
        "entity_type": pick("user_id", v.ENTITY_CYCLE), "entity_id": "user_id", "dim": "384",
        "query_name": "'q' || (event_id % 7)", "row_count": "event_id % 1000",
        "model_name": "'model_' || (event_id % 3)",
    }
    out = []
    for f in EVENT_SCHEMA.names:
        if f in ("logger", "exception"):
            continue
        kinds = [k for k, extra in EVENT_FIELDS.items() if f in extra]
        if kinds and f != "duration_ms":
            out.append(f"CASE WHEN event IN ({', '.join(map(lit, kinds))}) THEN {values[f]} END AS {f}")
        else:
            out.append(f"{values[f]} AS {f}")
    return ", ".join(out)


SLOW = "level IN ('WARNING', 'ERROR') AND regexp_matches(lower(msg), 'slow|took|timeout')"
add("events_typed", "fields", f"SELECT event_id, {typed_fields()} FROM fields")
add("tail_events", "fields", """
    WITH t AS (SELECT *, event_id % 89 = 0 AS empty, event_id % 97 = 0 AS cut FROM fields ORDER BY ts DESC, event_id DESC LIMIT 200)
    SELECT event_id AS line_no, CASE WHEN cut THEN 'UNKNOWN' ELSE level END AS level,
           CASE WHEN cut THEN 'cut ' || event_id || ' {' ELSE msg END AS msg,
           CASE WHEN NOT cut THEN request_id END AS request_id, CASE WHEN NOT cut THEN event END AS event,
           CASE WHEN NOT cut THEN took END AS duration_ms FROM t WHERE NOT empty""")
add("tail_files", "fields", f"""
    WITH t AS (SELECT *, event_id % 89 = 0 AS empty, event_id % 97 = 0 AS cut FROM fields ORDER BY ts DESC, event_id DESC LIMIT 200)
    SELECT CASE WHEN NOT cut THEN {ts('ts')} END AS ts, CASE WHEN cut THEN 'UNKNOWN' ELSE level END AS level,
           CASE WHEN cut THEN 'cut ' || event_id || ' {{' ELSE msg END AS msg,
           CASE WHEN NOT cut THEN request_id END AS request_id, CASE WHEN NOT cut THEN event END AS event,
           CASE WHEN NOT cut THEN took END AS duration_ms FROM t WHERE NOT empty""")
add("slow_queries", "fields", """
    SELECT 'q' || (event_id % 7) AS query_name, count(*) AS calls, count(*) FILTER (took > 500) AS slow_calls
    FROM fields WHERE event = 'db_query' GROUP BY 1""")
add("slow_ops", "fields", f"SELECT event_id, level, msg FROM fields WHERE {SLOW}")
add("log_stats", "", f"""
    WITH x AS (SELECT source AS log, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT log, {rounded('sum(strlen(line) + 1)', '1024', 1)} AS size_kb, count(*) AS lines FROM x GROUP BY log""")

# Writes

HASH = "substr(md5(path), 1, 3)"
add("append_with_defaults", "resume_files", f"""
    WITH {parsed('resume_files')},
    n AS (SELECT *, row_number() OVER (ORDER BY {HASH}, path) AS k FROM p WHERE NOT blank AND {DECODER} IS NOT NULL)
    SELECT (SELECT max(s_suppkey) FROM supplier) + k AS id, name, email, {text_list('skills')} AS skills, visa_status, yoe,
           CAST(NULL AS DOUBLE) AS rate, path AS resume_path, false AS is_active_contractor FROM n""")
ATTRITION = """round(
    0.2::DOUBLE * least(greatest((180.0::DOUBLE - tenure_days) / 180, 0.0), 1.0)
    + 0.3::DOUBLE * least(greatest(comms_gap_days / 30.0::DOUBLE, 0.0), 1.0)
    + 0.2::DOUBLE * least(greatest(overtime_pct / 25, 0.0), 1.0)
    + 0.3::DOUBLE * least(greatest((5.0::DOUBLE - client_feedback_score) / 5, 0.0), 1.0), 6)"""
add("predictions_written", "candidates", f"""
    SELECT 'candidate' AS entity_type, id AS entity_id, 'attrition' AS model_name, {ATTRITION} AS score,
           '{{"tenure_days":' || tenure_days || ',"comms_gap_days":' || comms_gap_days || '}}' AS features
    FROM candidates WHERE is_active_contractor""")
add("upsert_entities", "candidates", f"""
    WITH x AS (SELECT user_id AS id, ts, event_id, event_type IN ('click', 'purchase') AS sets_l,
                      event_type IN ('view', 'purchase') AS sets_r, CASE WHEN event_id % 10 <> 0 THEN value END AS rate FROM events),
    l AS (SELECT id, 'CITY_' || event_id AS location FROM x WHERE sets_l
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
    r AS (SELECT id, rate FROM x WHERE sets_r QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
    u AS (SELECT id, max(ts) AS at FROM x GROUP BY id)
    SELECT c.id, c.name, coalesce(l.location, c.location) AS location,
           CASE WHEN r.id IS NOT NULL THEN r.rate ELSE c.rate END AS rate, {ts('coalesce(u.at, c.created_at)')} AS updated_at
    FROM candidates c LEFT JOIN l ON l.id = c.id LEFT JOIN r ON r.id = c.id LEFT JOIN u ON u.id = c.id""")
add("insert_rejects", "recruiters clients", """
    WITH m AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 50 = 0 THEN 'nation_0@example.com'
                      WHEN c_custkey % 9 <> 0 THEN 'm' || (c_custkey % 700) || '@example.com' END AS email FROM customer),
    r AS (SELECT k, CASE WHEN email IS NULL THEN 'email not null'
                 WHEN email IN (SELECT email FROM recruiters) OR k > min(k) OVER (PARTITION BY email) THEN 'email unique' END AS rules FROM m),
    j AS (SELECT p_partkey AS k, concat_ws(',', CASE WHEN p_partkey % 31 = 0 THEN 'title not null' END,
                 CASE WHEN p_partkey % 17 = 0 THEN 'status in domain' END) AS own,
                 CASE WHEN p_partkey * 3 NOT IN (SELECT id FROM clients) THEN 'client_id in clients' END AS link FROM part)
    SELECT 'recruiters' AS "table", k AS "order", rules FROM r WHERE rules IS NOT NULL
    UNION ALL SELECT 'jobs', k, CASE WHEN own <> '' THEN own ELSE link END FROM j WHERE own <> '' OR link IS NOT NULL""")
add("update_rejects", "recruiters clients", """
    WITH x AS (SELECT user_id AS id, event_id AS seq, concat_ws(',',
        CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN 'name not null' END,
        CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'visa_status in domain' END,
        CASE WHEN event_id % 3 = 1 AND event_id % 60 > 32 THEN 'phone length <= 32' END) AS rules FROM events),
    c AS (SELECT event_id % 40 AS id, event_id AS seq, ts, CASE WHEN event_id % 11 <> 0 THEN 'nation_' || (event_id * 7 % 34) || '@example.com' END AS email
          FROM events WHERE event_id % 40 < 15 AND event_id % 3 <> 0),
    net AS (SELECT id, email AS new FROM c WHERE email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
    moves AS (SELECT net.id, r.email AS old, new FROM net JOIN recruiters r ON r.id = net.id WHERE r.email IS DISTINCT FROM new),
    refused AS (WITH RECURSIVE f AS (
        SELECT id FROM moves m WHERE EXISTS (SELECT 1 FROM moves o WHERE o.new = m.new AND o.id < m.id)
            OR EXISTS (SELECT 1 FROM recruiters r WHERE r.email = m.new AND r.id <> m.id AND r.id NOT IN (SELECT id FROM moves))
        UNION SELECT m.id FROM f JOIN moves k ON k.id = f.id JOIN moves m ON m.new = k.old) SELECT id FROM f),
    j AS (SELECT event_id % 500 AS id, event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN event_id * 3 END AS client_id FROM events WHERE event_id % 5 <> 0)
    SELECT 'candidates' AS "table", id, seq, rules FROM x WHERE rules <> ''
    UNION ALL SELECT 'recruiters', id, seq, CASE WHEN email IS NULL THEN 'email not null' ELSE 'email unique' END FROM c
        WHERE email IS NULL OR id IN (SELECT id FROM refused)
    UNION ALL SELECT 'jobs', id, seq, CASE WHEN client_id IS NULL THEN 'client_id not null' ELSE 'client_id in clients' END FROM j
        WHERE client_id IS NULL OR client_id NOT IN (SELECT id FROM clients)""")
ORACLES["written_updates"] = ORACLES["upsert_entities"]
add("timesheet_robust_findings", "timesheets", """
    WITH a AS (SELECT id, contractor_id, hours, row_number() OVER (PARTITION BY contractor_id ORDER BY hours) AS nth,
                      count(*) OVER (PARTITION BY contractor_id) AS n FROM timesheets),
    m AS (SELECT contractor_id, max(CASE WHEN nth = (n + 1) // 2 THEN hours END) AS median FROM a GROUP BY contractor_id),
    b AS (SELECT a.*, m.median, row_number() OVER (PARTITION BY a.contractor_id ORDER BY abs(hours - m.median)) AS place
          FROM a JOIN m ON m.contractor_id = a.contractor_id),
    d AS (SELECT contractor_id, max(CASE WHEN place = (n + 1) // 2 THEN abs(hours - median) END) AS mad FROM b GROUP BY contractor_id),
    f AS (SELECT b.id, b.contractor_id, hours, median, mad, round((hours - median) / nullif(1.4826::DOUBLE * mad, 0), 6) AS robust_score
          FROM b JOIN d ON d.contractor_id = b.contractor_id)
    SELECT * FROM f WHERE robust_score >= 1.5""")
add("job_metrics", "resume_files", f"""
    WITH o AS (SELECT {OUTCOME} AS status FROM resume_files)
    SELECT 'ingest_resumes' AS operation, count(*) AS n_rows, count(*) FILTER (status <> 'parsed') AS n_failed, 1 AS calls FROM o
    UNION ALL SELECT 'embed_candidates', count(*) FILTER (status = 'parsed'), 0, 1 FROM o""")
add("written_reset", "clients", """
    SELECT name AS "table", CASE WHEN name = 'clients' THEN (SELECT count(*) FROM clients) ELSE 0 END AS n_rows
    FROM (SELECT unnest(['clients', 'recruiters', 'candidates', 'jobs', 'placements', 'timesheets', 'payroll', 'predictions']) AS name)""")
add("written_predictions", "predictions", "SELECT id, entity_type, entity_id, score FROM predictions WHERE model_name = 'purchase'")
add("stored_embeddings", "", """
    WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings),
    x AS (SELECT id, unnest(range(0, len(v))) AS bucket, unnest(v)::DOUBLE AS weight FROM e)
    SELECT id, bucket, weight FROM x WHERE weight <> 0""")
add("upsert_rejects", "", """
    SELECT user_id AS id, event_id AS seq FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
CHANGED_STAGE = pick("event_id", (*STAGES, "bogus"))
add("stage_update", "placements", f"""
    WITH x AS (SELECT event_id * 2 AS id, {CHANGED_STAGE} AS stage, ts FROM events)
    SELECT p.id, coalesce(x.stage, p.stage) AS stage, {ts('coalesce(x.ts, p.updated_at)')} AS updated_at
    FROM placements p LEFT JOIN x ON x.id = p.id AND x.stage <> 'bogus'""")
add("stage_rejects", "placements", f"""
    WITH x AS (SELECT event_id * 2 AS id, {CHANGED_STAGE} AS stage FROM events)
    SELECT id, stage, CASE WHEN stage = 'bogus' THEN 'invalid stage' ELSE 'unknown id' END AS reason FROM x
    WHERE stage = 'bogus' OR id NOT IN (SELECT id FROM placements)""")
FINDINGS = """s AS (SELECT contractor_id, sum(hours) / count(*) AS mean,
        sqrt(greatest(sum(hours * hours) / count(*) - (sum(hours) / count(*)) * (sum(hours) / count(*)), 0.0::DOUBLE)) AS sd
        FROM timesheets GROUP BY contractor_id),
    f AS (SELECT t.id, t.contractor_id, t.hours, round((t.hours - s.mean) / nullif(s.sd, 0), 6) AS score,
                 CASE WHEN t.hours >= 60 THEN 'hours over limit' ELSE 'far above own mean' END AS reason
          FROM timesheets t JOIN s ON s.contractor_id = t.contractor_id
          WHERE t.hours >= 60 OR round((t.hours - s.mean) / nullif(s.sd, 0), 6) >= 1.65::DOUBLE)"""
add("timesheet_findings", "timesheets", f"WITH {FINDINGS} SELECT * FROM f")
add("flag_anomalies", "timesheets", f"""
    WITH {FINDINGS}, b AS (SELECT id, max({{'score': score, 'reason': reason}}) AS f FROM f GROUP BY id),
    u AS (SELECT t.contractor_id, CASE WHEN b.id IS NOT NULL THEN 'flagged' ELSE status END AS status,
                 CASE WHEN b.id IS NOT NULL THEN true ELSE anomaly_flag END AS anomaly_flag,
                 CASE WHEN b.id IS NOT NULL THEN b.f.reason ELSE anomaly_reason END AS anomaly_reason,
                 CASE WHEN b.id IS NOT NULL THEN b.f.score ELSE anomaly_score END AS anomaly_score
          FROM timesheets t LEFT JOIN b ON b.id = t.id)
    SELECT contractor_id, status, anomaly_flag, anomaly_reason, count(*) AS sheets, max(anomaly_score) AS top_score
    FROM u GROUP BY contractor_id, status, anomaly_flag, anomaly_reason""")
add("flag_rejects", "timesheets", f"""
    WITH {FINDINGS}
    SELECT -id AS id, reason, 'unknown id' AS rejected FROM f WHERE id % 7 = 0
    UNION ALL SELECT id, reason, 'ambiguous id' FROM f WHERE id % 7 <> 0 AND id % 5 = 0""")

# Vectors


def hashed_parts(source: str, key: str, dim: int, x: str = "") -> str:
    """WITH parts that end in {x}w: the non-zero vector entries (key, bucket, weight) of a text source."""
    return f"""{x}t AS (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source}),
    {x}h AS (SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS bucket,
                 CASE WHEN ('0x' || substr(md5(tok), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM {x}t WHERE tok <> ''),
    {x}b AS (SELECT {key}, bucket, sum(sign) AS s FROM {x}h GROUP BY {key}, bucket),
    {x}n AS (SELECT {key}, sqrt(CAST(sum(s * s) AS DOUBLE)) AS length FROM {x}b GROUP BY {key}),
    {x}w AS (SELECT {key}, bucket, CAST(CAST(CAST(s AS DOUBLE) / length AS FLOAT) AS DOUBLE) AS weight
             FROM {x}b JOIN {x}n USING ({key}) WHERE s <> 0)"""


def hashed(dim: int) -> str:
    return f"WITH {hashed_parts('documents', 'doc_id', dim)} SELECT doc_id, bucket, weight FROM w"


add("hash_embed", "", hashed(384))
add("embedding_quality", "", """
    WITH e AS (SELECT len(embedding) AS n, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm,
                      embedding IS NULL AS missing FROM embeddings)
    SELECT count(*) AS vectors, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT missing AND n <> 64) AS wrong_length,
           count(*) FILTER (norm = 0) AS zero, count(*) FILTER (norm <> 0 AND abs(norm - 1) > 0.01) AS not_unit FROM e""")
ALL_PAIRS = """p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour,
        round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""
add("cosine_topk", "", f"""
    WITH {ALL_PAIRS}
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS INT) AS rank, neighbour, similarity
    FROM p QUALIFY rank <= 3""")
add("cosine_neighbour_counts", "", f"""
    WITH {ALL_PAIRS}
    SELECT id, count(*) FILTER (similarity >= {NEIGHBOUR_THRESHOLD}) AS similar,
           max(similarity) FILTER (similarity >= {NEIGHBOUR_THRESHOLD}) AS highest FROM p GROUP BY id""")
add("cosine_pairs_over", "placements", f"""
    WITH d AS (SELECT DISTINCT candidate_id, job_id FROM placements),
    s AS (SELECT candidate_id, job_id,
                 round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
          FROM d JOIN embeddings a ON a.vec_id = candidate_id JOIN embeddings b ON b.vec_id = job_id)
    SELECT * FROM s WHERE similarity > {PAIR_THRESHOLD}""")

# Demo data


def draw(key: str, purpose: str) -> str:
    return f"(('0x' || substr(md5(({key}) || ':{purpose}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def whole(key: str, purpose: str, low: int, high: int) -> str:
    return f"CAST(floor({draw(key, purpose)} * {high - low + 1}) + {low} AS INT)"


def tenths(key: str, purpose: str, low: float, high: float) -> str:
    return f"({whole(key, purpose, round(low * 10), round(high * 10))} / 10.0::DOUBLE)"


def one_of(key: str, purpose: str, values) -> str:
    return f"({items(values)})[{whole(key, purpose, 0, len(values) - 1)} + 1]"


def by_share(key: str, purpose: str, shares: dict[str, float]) -> str:
    *firsts, last = shares
    upto, whens = 0, ""
    for name in firsts:
        upto += round(shares[name] * 100)
        whens += f" WHEN {draw(key, purpose)} < {upto / 100}::DOUBLE THEN {lit(name)}"
    return f"CASE{whens} ELSE {lit(last)} END"


def some_skills(key: str, purpose: str, low: int, high: int) -> str:
    hashes = f"list_transform({items(seed.SKILLS)}, lambda s: {{'h': md5(({key}) || ':{purpose}:' || s), 's': s}})"
    return f"list_transform(list_sort({hashes}), lambda x: x.s)[1:{whole(key, purpose, low, high)}]"


SEEDED = {
    "candidates": f"""SELECT s_suppkey AS id, 'Candidate ' || id AS name, 'candidate' || id || '@example.com' AS email,
        '+1-555-' || {whole('s_suppkey', 'phone', 1000, 9999)} AS phone, {some_skills('s_suppkey', 'skills', 3, 7)} AS skills,
        {by_share('s_suppkey', 'visa', seed.VISA_SHARES)} AS visa_status, {one_of('s_suppkey', 'location', seed.CITIES)} AS location,
        {tenths('s_suppkey', 'yoe', 1, 15)} AS yoe, CAST({whole('s_suppkey', 'rate', 50, 140)} AS DOUBLE) AS rate,
        {draw('s_suppkey', 'contractor')} < 0.4::DOUBLE AS is_active_contractor,
        CASE WHEN is_active_contractor THEN {whole('s_suppkey', 'tenure', 30, 720)} END AS tenure_days,
        CASE WHEN is_active_contractor THEN {whole('s_suppkey', 'gap', 0, 30)} END AS comms_gap_days,
        CASE WHEN is_active_contractor THEN {tenths('s_suppkey', 'overtime', 0, 25)} END AS overtime_pct,
        CASE WHEN is_active_contractor THEN {tenths('s_suppkey', 'feedback', 2.5, 5)} END AS client_feedback_score
        FROM supplier""",
    "jobs": f"""SELECT p_partkey AS id, {one_of('p_partkey', 'title', ('Data', 'Cloud', 'Backend', 'Security', 'Platform'))}
        || ' Engineer' AS title, {some_skills('p_partkey', 'required', 3, 6)} AS required_skills,
        {one_of('p_partkey', 'location', seed.CITIES)} AS location,
        'We need a ' || title || ' with ' || array_to_string(required_skills[1:3], ', ') || ' in ' || location || '.' AS jd_text,
        {draw('p_partkey', 'remote')} < 0.3::DOUBLE AS remote_ok, CAST({whole('p_partkey', 'rate_min', 50, 90)} AS DOUBLE) AS rate_min,
        rate_min + {whole('p_partkey', 'rate_span', 15, 40)} AS rate_max,
        CASE WHEN {draw('p_partkey', 'visa_requirement')} >= 0.7::DOUBLE THEN 'citizen' END AS visa_requirement,
        {tenths('p_partkey', 'min_yoe', 1, 5)} AS min_yoe, {tenths('p_partkey', 'max_yoe', 6, 15)} AS max_yoe,
        {by_share('p_partkey', 'status', seed.JOB_STATUS_SHARES)} AS status,
        CAST(floor({draw('p_partkey', 'client')} * 4294967296) AS BIGINT) AS client_draw FROM part""",
}

add("seed_clients", "", f"""
    SELECT c_custkey AS id, 'Client ' || c_custkey AS name, {one_of('c_custkey', 'industry', seed.INDUSTRIES)} AS industry,
           'Contact Person ' || c_custkey AS contact_name, 'contact' || c_custkey || '@example.com' AS contact_email,
           'active' AS status, {whole('c_custkey', 'req_volume', 1, 8)} AS req_volume,
           {tenths('c_custkey', 'margin_pct', 8, 30)} AS margin_pct FROM customer""")
add("seed_recruiters", "", f"""
    SELECT CAST(n_nationkey AS BIGINT) AS id, 'Recruiter ' || n_nationkey AS name,
           'recruiter' || n_nationkey || '@example.com' AS email,
           {one_of('n_nationkey', 'team', ('East', 'West', 'Central'))} AS team FROM nation""")
add("seed_candidates", "", f"""
    WITH c AS ({SEEDED['candidates']}) SELECT * REPLACE ({text_list('skills')} AS skills) FROM c""")
add("seed_jobs", "", f"""
    WITH j AS ({SEEDED['jobs']})
    SELECT * EXCLUDE (client_draw) REPLACE ({text_list('required_skills')} AS required_skills),
           client_draw % (SELECT count(*) FROM customer) AS client_id FROM j""")
K = "o_orderkey"
add("seed_placements", "", f"""
    WITH j AS ({SEEDED['jobs']}),
    d AS (SELECT o_orderkey AS id, CAST(floor({draw(K, 'candidate')} * (SELECT count(*) FROM supplier)) AS BIGINT) AS candidate_id,
                 CAST(floor({draw(K, 'job')} * (SELECT count(*) FROM part)) AS BIGINT) AS job_id,
                 CAST(floor({draw(K, 'recruiter')} * (SELECT count(*) FROM nation)) AS BIGINT) AS recruiter_id,
                 {draw(K, 'bill')} AS u_bill, CAST({draw(K, 'pay')} * 0.2::DOUBLE + 0.65::DOUBLE AS DECIMAL(10,6)) AS factor,
                 {by_share(K, 'stage', seed.STAGE_SHARES)} AS stage, {tenths(K, 'match', 40, 98)} AS match_score,
                 ({some_skills(K, 'missing', 1, 3)})[1:{whole(K, 'n_missing', 0, 3)}] AS missing,
                 {whole(K, 'age', 0, 180)} AS age FROM orders),
    b AS (SELECT d.*, j.client_draw % (SELECT count(*) FROM customer) AS client_id,
                 CAST(CAST(rate_min + u_bill * (rate_max - rate_min) AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS bill
          FROM d JOIN j ON j.id = d.job_id),
    p AS (SELECT *, CAST(bill * factor AS DECIMAL(18,2)) AS pay FROM b)
    SELECT id, candidate_id, job_id, recruiter_id, client_id, stage, match_score,
           '{{"missing":[' || array_to_string(list_transform(missing, lambda x: '"' || x || '"'), ',') || '],"severity":"'
           || (['none', 'low', 'medium', 'high'])[len(missing) + 1] || '"}}' AS skill_gap,
           CAST(bill AS DOUBLE) AS bill_rate, CAST(pay AS DOUBLE) AS pay_rate, CAST(bill - pay AS DOUBLE) AS margin,
           {ts(f"TIMESTAMP '{AS_OF}' - to_days(age)")} AS submitted_at FROM p""")
W = "id || '-' || back"
add("seed_timesheets", "", f"""
    WITH c AS ({SEEDED['candidates']}),
    w AS (SELECT id, unnest(range(0, {seed.WEEKS})) AS back FROM c WHERE is_active_contractor),
    h AS (SELECT *, {draw(W, 'anomaly')} < 0.05::DOUBLE AS odd,
                 CASE WHEN {draw(W, 'anomaly')} < 0.05::DOUBLE THEN {tenths(W, 'long_hours', 60, 80)}
                      ELSE {tenths(W, 'hours', 35, 45)} END AS hours FROM w)
    SELECT id AS contractor_id, {day(f"date_trunc('week', DATE '{AS_OF}' - CAST(back * 7 AS INT))")} AS week_start, hours,
           greatest(CAST(round(hours * 10) AS INT) - 400, 0) / 10.0::DOUBLE AS overtime_hours,
           CASE WHEN odd THEN 'flagged' ELSE 'approved' END AS status, odd AS anomaly_flag,
           CASE WHEN odd THEN {whole(W, 'score', 70, 95)} / 100.0::DOUBLE END AS anomaly_score,
           CASE WHEN odd THEN 'Unusually high weekly hours' END AS anomaly_reason FROM h""")
add("seed_payroll", "", f"""
    WITH c AS ({SEEDED['candidates']}),
    m AS (SELECT id, CAST(rate AS INT) AS rate, {whole('id', 'bill_factor', 125, 160)} AS factor,
                 unnest(range(0, {seed.PAY_PERIODS})) AS back FROM c WHERE is_active_contractor)
    SELECT id AS contractor_id, {day(f"date_trunc('month', DATE '{AS_OF}' - to_months(CAST(back AS INT)))")} AS period,
           rate * factor / 100.0::DOUBLE AS bill_rate, CAST(rate AS DOUBLE) AS pay_rate,
           (rate * factor - rate * 100) / 100.0::DOUBLE AS margin,
           CAST((2 * (rate * factor - rate * 100) * 1000 + rate * factor) // (2 * rate * factor) AS DOUBLE) / 10 AS margin_pct
    FROM m""")

# Reports by this package's own definitions

MISSING = "list_filter(j.required_skills, lambda x: NOT list_contains(k.skills, x))"
add("match_scores", "placements candidates jobs", f"""
    SELECT p.id, p.candidate_id, p.job_id,
           50.0::DOUBLE * (len(j.required_skills) - len({MISSING})) / len(j.required_skills)
           + CASE WHEN j.visa_requirement IS NULL OR j.visa_requirement = k.visa_status THEN 20 ELSE 0 END
           + CASE WHEN k.yoe BETWEEN j.min_yoe AND j.max_yoe THEN 20 ELSE 0 END
           + CASE WHEN k.rate <= j.rate_max THEN 10 ELSE 0 END AS match_score,
           '{{"missing":[' || array_to_string(list_transform({MISSING}, lambda x: '"' || x || '"'), ',') || '],"severity":"'
           || CASE WHEN len({MISSING}) = 0 THEN 'none' WHEN len({MISSING}) * 3 <= len(j.required_skills) THEN 'low'
                   WHEN len({MISSING}) * 3 <= len(j.required_skills) * 2 THEN 'medium' ELSE 'high' END || '"}}' AS skill_gap
    FROM placements p JOIN candidates k ON k.id = p.candidate_id JOIN jobs j ON j.id = p.job_id""")
add("best_candidates", "jobs candidates", f"""
    WITH job_texts AS (SELECT id AS job_id, {JOB_TEXT} AS text FROM jobs WHERE status = 'open'),
    candidate_texts AS (SELECT id AS candidate_id, concat_ws(chr(10), 'Skills: ' || array_to_string(skills, ', '), 'Location: ' || location,
        'Visa: ' || visa_status, CASE WHEN yoe <> 0 THEN 'Years of experience: ' || CAST(yoe AS VARCHAR) END) AS text FROM candidates),
    {hashed_parts('job_texts', 'job_id', 384, 'j')}, {hashed_parts('candidate_texts', 'candidate_id', 384, 'c')},
    jl AS (SELECT job_id, sqrt(sum(weight * weight)) AS l FROM jw GROUP BY job_id),
    cl AS (SELECT candidate_id, sqrt(sum(weight * weight)) AS l FROM cw GROUP BY candidate_id),
    d AS (SELECT job_id, candidate_id, sum(jw.weight * cw.weight) AS dot FROM jw JOIN cw ON jw.bucket = cw.bucket GROUP BY ALL),
    p AS (SELECT job_id, candidate_id, round(coalesce(dot, 0) / (jl.l * cl.l), 6) AS similarity
          FROM jl CROSS JOIN cl LEFT JOIN d USING (job_id, candidate_id)
          JOIN jobs j ON j.id = job_id JOIN candidates c ON c.id = candidate_id
          WHERE (j.visa_requirement IS NULL OR j.visa_requirement = c.visa_status)
            AND coalesce(c.yoe, 0) >= coalesce(j.min_yoe, coalesce(c.yoe, 0)) AND coalesce(c.yoe, 0) <= coalesce(j.max_yoe, coalesce(c.yoe, 0))
            AND (j.rate_max IS NULL OR c.rate <= j.rate_max)
            AND (len(j.required_skills) = 0 OR list_has_any(j.required_skills, c.skills)))
    SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, candidate_id) AS INT) AS rank,
           candidate_id, similarity FROM p QUALIFY rank <= 3""")
add("client_refresh", "clients jobs placements", """
    SELECT c.id, c.name, CAST((SELECT count(*) FROM jobs j WHERE j.client_id = c.id AND j.status = 'open') AS INT) AS req_volume,
           m.pct AS margin_pct
    FROM clients c LEFT JOIN (
        SELECT client_id, CAST(sum(CAST(margin AS DECIMAL(18,4))) AS DOUBLE) * 100
               / nullif(CAST(sum(CAST(bill_rate AS DECIMAL(18,2))) AS DOUBLE), 0) AS pct
        FROM placements GROUP BY client_id) m ON m.client_id = c.id""")
MTD = f"submitted_at >= date_trunc('month', DATE '{AS_OF}') AND submitted_at < DATE '{AS_OF}' + 1"
KPIS = f"""SELECT 'open_jobs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM jobs WHERE status = 'open'
    UNION ALL SELECT 'active_contractors', CAST(count(*) AS DOUBLE) FROM candidates WHERE is_active_contractor
    UNION ALL SELECT 'submissions_mtd', CAST(count(*) AS DOUBLE) FROM placements WHERE {MTD}
    UNION ALL SELECT 'hires_mtd', CAST(count(*) AS DOUBLE) FROM placements WHERE {MTD} AND stage = 'hire'"""
add("landing_kpis", "jobs candidates placements", KPIS)
add("attrition_risk", "candidates", f"""
    SELECT id, name, {ATTRITION} AS attrition_risk_score FROM candidates WHERE is_active_contractor""")
add("client_churn", "placements", f"""
    WITH w AS (SELECT *, submitted_at >= TIMESTAMP '{AS_OF}' - to_days(180) AS late, CAST(bill_rate AS DECIMAL(18,2)) AS bill
               FROM placements WHERE submitted_at >= TIMESTAMP '{AS_OF}' - to_days(360) AND submitted_at < TIMESTAMP '{AS_OF}'),
    g AS (SELECT client_id, count(*) FILTER (late) AS recent, count(*) FILTER (NOT late) AS earlier,
                 coalesce(sum(bill) FILTER (late), 0) AS r, coalesce(sum(bill) FILTER (NOT late), 0) AS e,
                 max(submitted_at) AS last_at FROM w GROUP BY client_id)
    SELECT client_id, recent, earlier, CAST(r AS DOUBLE) AS recent_revenue, CAST(e AS DOUBLE) AS earlier_revenue,
           CAST(date_diff('day', last_at, TIMESTAMP '{AS_OF}') AS INT) AS days_since_last,
           CASE WHEN recent = 0 THEN 'high' WHEN r * 2 <= e THEN 'medium' ELSE 'low' END AS risk FROM g""")
add("revenue_forecast", "payroll", f"""
    WITH m AS (SELECT CAST(date_trunc('month', period) AS DATE) AS month,
                      CAST(sum(CAST(bill_rate AS DECIMAL(18,2))) * 100 AS HUGEINT) AS y,
                      date_diff('month', DATE '1970-01-01', CAST(date_trunc('month', period) AS DATE)) AS x
               FROM payroll GROUP BY ALL),
    f AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, max(month) AS last,
                 CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) AS slope FROM m),
    a AS (SELECT f.*, CAST(last + to_months(CAST(step AS INT)) AS DATE) AS month FROM f, range(1, 7) AS t(step))
    SELECT {day('a.month')} AS month,
           round((CAST(sy AS DOUBLE) / CAST(n AS DOUBLE) + slope * (CAST(date_diff('month', DATE '1970-01-01', a.month) AS DOUBLE)
                  - CAST(sx AS DOUBLE) / CAST(n AS DOUBLE))) / 100, 2) AS trend,
           CAST(m.y AS DOUBLE) / 100 AS seasonal
    FROM a LEFT JOIN m ON m.month + to_months(12) = a.month""")
add("recruiter_kpis", "placements recruiters", """
    WITH w AS (SELECT recruiter_id, count(*) AS submissions, count(*) FILTER (stage = 'hire') AS hires,
                      CAST(sum(CAST(margin AS DECIMAL(18,4))) AS DOUBLE) AS margin FROM placements GROUP BY recruiter_id),
    r AS (SELECT id, name, team, coalesce(submissions, 0) AS submissions, coalesce(hires, 0) AS hires,
                 coalesce(margin, 0) AS margin FROM recruiters LEFT JOIN w ON recruiter_id = id)
    SELECT *, hires / nullif(submissions, 0) AS conversion,
           CAST(row_number() OVER (PARTITION BY team ORDER BY hires DESC, margin DESC, id) AS INT) AS team_rank FROM r""")
FUNNEL = "s(position, stage) AS (VALUES " + ", ".join(f"({i + 1}, {lit(s)})" for i, s in enumerate(STAGES)) + """),
    n AS (SELECT s.position, s.stage, count(p.id) AS count FROM s LEFT JOIN placements p ON p.stage = s.stage GROUP BY ALL)"""
add("funnel_conversion", "placements", f"""
    WITH {FUNNEL}
    SELECT position, stage, count, CASE WHEN stage <> 'rejected' THEN count / nullif(lag(count) OVER (ORDER BY position), 0) END AS ratio
    FROM n""")
add("visa_compliance", "candidates", """
    SELECT visa_status, count(*) AS candidates, count(*) FILTER (is_active_contractor) AS active_contractors
    FROM candidates GROUP BY visa_status""")
add("hire_rates", "placements jobs", """
    WITH x AS (SELECT p.client_id, p.stage, unnest(j.required_skills) AS skill FROM placements p JOIN jobs j ON j.id = p.job_id)
    SELECT client_id, skill, count(*) AS placements, count(*) FILTER (stage = 'hire') AS hires,
           count(*) FILTER (stage = 'hire') / count(*) AS hire_rate FROM x GROUP BY client_id, skill""")
add("executive_summary", "jobs candidates placements clients payroll", f"""
    WITH {FUNNEL}, k AS ({KPIS})
    SELECT metric, value FROM k UNION ALL SELECT 'stage_' || stage, CAST(count AS DOUBLE) FROM n
    UNION ALL SELECT 'payroll_revenue', CAST(sum(CAST(bill_rate AS DECIMAL(18,2))) AS DOUBLE) FROM payroll
    UNION ALL SELECT 'payroll_rows', CAST(count(*) AS DOUBLE) FROM payroll
    UNION ALL SELECT 'leaking_clients', CAST(count(*) AS DOUBLE) FROM clients WHERE margin_pct < 15""")

# Streams: what a batch over the same rows gives

add("stream_slow_ops", "fields", f"SELECT event_id, level, msg FROM fields WHERE {SLOW}")
add("stream_without_duplicates", "fields", "SELECT event_id, event FROM fields")
add("stream_incremental_embed", "", hashed(STREAM_DIM))
# All windows, those still open at the end of the files too.
add("stream_event_metrics", "fields", f"""
    WITH x AS (SELECT date_trunc('hour', ts) AS hour, event, error, took, CAST(greatest(floor(took * 1000), 0) AS BIGINT) AS us FROM fields),
    y AS (SELECT *, CASE WHEN took IS NOT NULL THEN greatest(length(bin(us)) - 8, 0) END AS shift FROM x),
    z AS (SELECT *, ((us >> shift) + 1 << shift) - 1 AS edge,
                 row_number() OVER (PARTITION BY hour, event ORDER BY us) AS nth, count(took) OVER (PARTITION BY hour, event) AS n FROM y)
    SELECT {ts("hour")} AS window_start, {ts("hour + INTERVAL 1 HOUR")} AS window_end, event,
           count(*) AS calls, count(error) AS errors,
           CAST(sum(CAST(took AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_ms, max(took) AS max_ms,
           min(CASE WHEN nth * 100 >= n * 95 THEN edge END) / 1000 AS p95_ms
    FROM z GROUP BY hour, event""")
