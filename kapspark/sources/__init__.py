"""Scans and sinks: ledger CSV, rate tables and payloads, rules, dimensions."""
