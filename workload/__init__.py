"""Inputs, queries and SQL checks over the test tables."""
