"""Writing sanitized texts, results, reports and archives."""
