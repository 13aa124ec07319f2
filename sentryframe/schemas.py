"""Declared schemas of the tables the operators exchange."""

from __future__ import annotations

CORPUS = "text string, label int, category string, source string"
CONDITION = "struct<field:string,op:string,value_num:double,value_str:string,value_list:array<string>>"
POLICY = f"role string, description string, tools array<struct<name:string,resource_patterns:array<string>,conditions:array<{CONDITION}>>>"
CALL = "call_id long, ts timestamp, session_id string, role string, tool_name string, resource string, params map<string,string>"
CREDENTIAL = "token_id string, role string, issued_at timestamp, expires_at timestamp, derived_from string"
AUDIT = "log_id string, seq long, payload string, prev_hash string, hash string"
VIOLATIONS = ("none", "credential_expired", "credential_revoked", "unknown_role", "tool_not_permitted", "resource_denied", "condition_denied", "credential_role_mismatch")
