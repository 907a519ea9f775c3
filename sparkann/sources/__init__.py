"""Readers and writers of vector, index and log files."""
