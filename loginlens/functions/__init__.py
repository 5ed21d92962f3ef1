"""Column expressions: geography, time, text, statistics, validation."""
