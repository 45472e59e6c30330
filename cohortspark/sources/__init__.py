"""Readers, writers, declared schemas and import reconciliation."""
