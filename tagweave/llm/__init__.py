"""Operators for training-data pipelines (tokenizers, dedup, PII, scoring,
extraction, search).  Nothing else in the package imports this subpackage."""
