"""Readers for raw feeds and writers for time-partitioned tables."""
