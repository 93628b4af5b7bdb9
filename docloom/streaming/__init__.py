"""Stateful and incremental runs."""
