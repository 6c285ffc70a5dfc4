"""Readers and writers: tables, archives, fixture files."""
