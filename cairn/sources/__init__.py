"""Stores, readers and writers."""
