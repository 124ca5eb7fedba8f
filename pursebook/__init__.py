"""Shared-expense ledger analytics as Spark jobs."""
