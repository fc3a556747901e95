"""Readers, writers and table adapters."""
