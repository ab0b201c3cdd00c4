"""Operators over DataFrames: joins, grouped metrics, guardrails, checks, table changes."""
