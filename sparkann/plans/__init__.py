"""The registry of queries and their SQL."""
