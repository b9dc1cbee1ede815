"""veilspan: text redaction and span analytics as Spark DataFrame expressions."""

__version__ = "0.1.0"
