"""Column expressions: text cleaning, tokens, fixed word lists."""
