"""Wiring (``tax_run``), the named query catalog and its SQL oracle."""
