"""Readers and writers of reports, knowledge-base tables and stage tables."""
