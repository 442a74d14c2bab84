"""Registered queries: every operator over the test tables, with its SQL check."""
