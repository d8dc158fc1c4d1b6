"""Column helpers and their SQL twins."""
