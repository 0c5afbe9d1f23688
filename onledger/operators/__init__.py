"""Reusable DataFrame operators: two-level scans, joins, lots, rules, upserts."""
