"""Detectors, reconciliation, masking, Japanese text and evaluation."""
