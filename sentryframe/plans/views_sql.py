"""The agent views in DuckDB SQL, as common table expressions for the compared statements."""

from __future__ import annotations

import json

from ..config import BASE_TRUST, COMPANY_ADDRESS, ROLE_SOURCE_TYPE, ROLES
from ..sources.tables import POLICY_DIR


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def score_of(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT / 4294967295.0)"


def case(key: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {v if isinstance(v, (int, float)) else quoted(v)}" for k, v in values.items()) + f" ELSE {other} END"


CALLS = f"""calls AS (
SELECT event_id AS call_id, ts, user_id, user_id::VARCHAR || '-' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::VARCHAR AS session_id,
 'tok' || user_id::VARCHAR AS token_id,
 CASE WHEN k % 4 = 0 THEN [{", ".join(map(quoted, ROLES))}][user_id % 6 + 1] ELSE
 {case("event_type", {"purchase": "support_agent", "view": "research_agent", "error": "code_exec_agent", "click": "email_agent", "signup": "calendar_agent"})} END AS role,
 {case("event_type", {"purchase": "issue_refund", "view": "fetch_url", "error": "run_code", "click": "send_email", "signup": "create_event"})} AS tool_name,
 CASE event_type WHEN 'purchase' THEN 'order_' || (k % 5)::VARCHAR
  WHEN 'view' THEN CASE WHEN k % 9 = 0 THEN 'file:///d' ELSE 'https://d' || (k % 12)::VARCHAR || '.example.com/p' END
  WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN '/etc/s' ELSE '/sandbox/s' || k::VARCHAR || '.py' END
  WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'attacker@evil.com' ELSE {quoted(COMPANY_ADDRESS)} END END AS resource,
 {case("event_type", {"purchase": "amount_usd", "error": "timeout_seconds", "click": "recipient_count", "signup": "attendee_count"})} AS field,
 CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN value WHEN 'click' THEN (k % 10)::DOUBLE WHEN 'signup' THEN (k % 20)::DOUBLE END AS amount,
 value, k, {score_of("event_id::VARCHAR")} AS injection
FROM (SELECT *, (json_extract(props, '$.k'))::INT AS k FROM events))"""


def _permissions() -> str:
    rows = []
    for p in sorted(POLICY_DIR.glob("*.json")):
        policy = json.loads(p.read_text())
        for t in policy["tools"]:
            c = t["conditions"][0] if t["conditions"] else {"field": None, "value_num": None}
            rows.append(f"({quoted(policy['role'])}, {quoted(t['name'])}, [{', '.join(map(quoted, t['resource_patterns']))}], {quoted(c['field'])}, {'NULL' if c['value_num'] is None else float(c['value_num'])})")
    return "perms AS (SELECT * FROM (VALUES " + ",\n ".join(rows) + ") AS p(role, tool_name, patterns, c_field, c_max))"


PERMISSIONS = _permissions()
#: Adds violation to calls, as the library's authorize does without credentials.
DECIDED = """decided AS (
SELECT c.*, CASE WHEN c.role NOT IN (SELECT role FROM perms) THEN 'unknown_role' WHEN p.tool_name IS NULL THEN 'tool_not_permitted'
 WHEN c.resource IS NOT NULL AND NOT list_bool_or([c.resource GLOB x FOR x IN p.patterns]) THEN 'resource_denied'
 WHEN p.c_field IS NOT NULL AND NOT (coalesce(c.field, '') = p.c_field AND coalesce(c.amount <= p.c_max, FALSE)) THEN 'condition_denied' ELSE 'none' END AS violation
FROM calls c LEFT JOIN perms p ON c.role = p.role AND c.tool_name = p.tool_name)"""
AUTHORIZED = f"{CALLS},\n{PERMISSIONS},\n{DECIDED}"
PROMPTS = f"prompts AS (SELECT d.doc_id, d.text, l.toxic AS label, {score_of('d.text')} AS score FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)"
CORPUS = "corpus AS (SELECT d.doc_id AS ord, d.text, l.toxic AS label, coalesce(d.lang, 'unknown') AS category, ['hf_csv', 'hf_csv2', 'hf_csv3', 'hf_csv4', 'other'][d.doc_id % 5 + 1] AS raw_source FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)"
NAMED = f"{CORPUS},\nnamed AS (SELECT *, CASE raw_source WHEN 'hf_csv' THEN 'neuralchemy' WHEN 'hf_csv2' THEN 'qualifire_holdout' WHEN 'hf_csv3' THEN 'necent' WHEN 'hf_csv4' THEN 'mindgard' ELSE raw_source END AS source, CASE WHEN raw_source = 'hf_csv2' THEN 'test' ELSE 'train' END AS split_role FROM corpus)"
UNIQUE = f"{NAMED},\nuniq AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY split_role, sha256(text) ORDER BY ord) = 1)"
SPLIT = f"""{UNIQUE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42' || text || ord::VARCHAR), ord) AS r, count(*) OVER (PARTITION BY label) AS n FROM uniq WHERE split_role = 'train'),
parts AS (SELECT ord, text, label, category, raw_source, source, split_role, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.1)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM ranked
 UNION ALL SELECT ord, text, label, category, raw_source, source, split_role, 'test' FROM uniq WHERE split_role = 'test')"""
TAGGED = f"tagged AS (SELECT *, {case('role', ROLE_SOURCE_TYPE, quoted('user_input'))} AS source_type, coalesce(nullif(resource, ''), role) AS source_id FROM calls)"
BASE = case("source_type", BASE_TRUST, "0.5")
HISTORY = f"""hist AS (SELECT *, row_number() OVER w AS n FROM (SELECT *, CASE WHEN value < 50 THEN 1 ELSE 0 END AS outcome FROM tagged WHERE call_id % 5 = 0) WINDOW w AS (PARTITION BY source_type, source_id ORDER BY ts, call_id)),
folded AS (SELECT a.source_type, a.source_id, a.ts, a.call_id, a.n, {BASE.replace("source_type", "a.source_type")} * pow(0.8, a.n) + 0.2 * (SELECT sum(b.outcome * pow(0.8, a.n - b.n)) FROM hist b WHERE b.source_type = a.source_type AND b.source_id = a.source_id AND b.n <= a.n AND b.n > a.n - 200) AS trust FROM hist a)"""
CREDENTIALS = "creds AS (SELECT DISTINCT 'tok' || user_id::VARCHAR AS token_id, user_id, TIMESTAMP '2024-01-01 00:00:00' AS issued_at, (user_id % 40 + 1) * 86400 AS ttl_seconds, CASE WHEN user_id > 0 THEN 'tok' || (user_id // 3)::VARCHAR END AS derived_from FROM events)"
