"""Column expressions: parsing, text, scoring, time, vectors and redaction."""
