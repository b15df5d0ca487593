"""Operators for preparing text corpora: formatting, scanning, deduplication, scoring, sharding."""
