"""Declared schemas of the domain tables."""
from __future__ import annotations

from paperloom import rules

_MONEY = "decimal(18,2)"
_SALARY_MONEY = ", ".join(f"{k} {_MONEY}" for k in rules.SALARY_MONEY_KEYS)


def _typed(fields: dict[str, tuple[str, list[str]]]) -> str:
    kinds = {"money": _MONEY, "quantity": "decimal(18,3)", "date": "date", "text": "string"}
    return ", ".join(f"{name} {kinds[kind]}" for name, (kind, _) in fields.items())


TABLES: dict[str, str] = {
    "family_members": "member_id bigint, name string, phone string, role string, is_active boolean, is_admin boolean, created_at timestamp",
    "permissions": "role string, resource string, can_read boolean, can_write boolean",
    "documents": (
        f"doc_id bigint, uploaded_by bigint, file_path string, filename string, doc_type string, vendor string, amount {_MONEY}, "
        "currency string, doc_date date, description string, ai_summary string, raw_text string, display_name string, "
        "source string, metadata map<string,string>, tags array<string>, confidence double, review_state string, created_at timestamp"
    ),
    "document_facts": (
        "document_id bigint, fact_seq bigint, fact_type string, fact_key string, fact_value string, confidence double, "
        "source_excerpt string, created_at timestamp"
    ),
    "salary_slips": (
        f"document_id bigint, member_id bigint, employee_name string, employer_name string, pay_year int, pay_month int, "
        f"currency string, {_SALARY_MONEY}, extraction_confidence double, review_state string, review_reason string, "
        f"source_channel string, {_typed(rules.SALARY_EXTENDED)}, employee_address string"
    ),
    "utility_bills": (
        f"document_id bigint, member_id bigint, provider_slug string, provider_name string, service_type string, "
        f"account_number string, bill_number string, issue_date date, period_start date, period_end date, amount_due {_MONEY}, "
        f"currency string, extraction_confidence double, review_state string, review_reason string, source_channel string, "
        f"{_typed(rules.UTILITY_EXTENDED)}"
    ),
    "contracts": (
        f"document_id bigint, uploaded_by bigint, source string, contract_type string, counterparty string, parties string, "
        f"contract_date date, start_date date, end_date date, amount {_MONEY}, currency string, obligations string, "
        "renewal_terms string, penalty_clause string, termination_clause string, governing_law string, "
        "document_reference string, confidence double, review_state string"
    ),
    "insurance_policies": (
        f"document_id bigint, uploaded_by bigint, source string, insurance_type string, insurer string, policy_number string, "
        f"insured_name string, beneficiary string, coverage_description string, coverage_limit {_MONEY}, premium_amount {_MONEY}, "
        f"premium_currency string, deductible_amount {_MONEY}, policy_date date, start_date date, end_date date, "
        "confidence double, review_state string"
    ),
    "transactions": f"document_id bigint, category string, amount {_MONEY}, currency string, direction string, transaction_date date, description string, created_at timestamp",
    "audit_log": "actor_id bigint, action string, resource_type string, resource_id bigint, details string, created_at timestamp",
    "recurring_patterns": "pattern_id bigint, title string, frequency string, next_due_date date, auto_create_days_before int, is_active boolean, assigned_to bigint, category string",
    "tasks": (
        "task_id bigint, title string, created_by bigint, assigned_to bigint, status string, priority string, due_date date, "
        "category string, created_at timestamp, completed_at timestamp, recurring_pattern_id bigint"
    ),
    "conversations": "message_id bigint, member_id bigint, ts timestamp, message_in string, message_out string, intent string",
    "memories": (
        "memory_id bigint, member_id bigint, content string, category string, memory_type string, expires_at timestamp, source string, "
        "confidence double, last_accessed_at timestamp, access_count int, is_active boolean, created_at timestamp"
    ),
    "memory_exclusions": "pattern string, exclusion_type string, member_id bigint, is_active boolean",
    "bug_reports": "bug_id bigint, reported_by bigint, description string, status string, priority string, created_at timestamp",
    "conversation_state": (
        "member_id bigint, last_intent string, last_entity_type string, last_entity_id bigint, last_action string, "
        "pending_confirmation boolean, pending_action string, context string, updated_at timestamp"
    ),
    "canonical_facts": (
        "fact_id bigint, subject_member_id bigint, location_key string, fact_key string, fact_value string, category string, "
        "created_by bigint, is_active boolean, created_at timestamp"
    ),
}
