"""Column functions: kinds, spans, text and lexicon predicates."""
