"""Column functions: text rules, strict JSON, redaction and the fixed values."""
