"""Column expressions: geography, text, time, opening hours, quality."""
