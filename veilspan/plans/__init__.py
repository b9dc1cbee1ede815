"""Whole plans: detection, masking, evaluation input and lexicon jobs."""
