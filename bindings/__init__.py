"""Queries and SQL checks that bind the operators to the test tables."""
