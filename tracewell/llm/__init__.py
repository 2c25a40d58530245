"""Operators for large training corpora: sharding, de-duplication, scans, mixing, scoring, encoding."""
