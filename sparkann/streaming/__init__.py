"""Micro-batch serving."""
