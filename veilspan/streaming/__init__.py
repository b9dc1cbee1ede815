"""Redaction of streams."""
