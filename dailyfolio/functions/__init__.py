"""Column expressions: text, scores, bot commands and messages."""
