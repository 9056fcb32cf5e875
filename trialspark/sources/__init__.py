"""Readers and writers for trial tables, prediction files, run logs and fitted state."""
