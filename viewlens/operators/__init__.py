"""Reusable DataFrame operators: filters, aggregates, windows, joins."""
