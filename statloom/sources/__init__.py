"""Readers, declared schemas and writers."""
