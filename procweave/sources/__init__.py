"""Readers, stores and writers."""
