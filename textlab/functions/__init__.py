"""Column expressions: text, page markup and value helpers."""
