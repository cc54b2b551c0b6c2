"""Column functions: regular-expression dialect, text, hashing and log redaction."""
