"""Column functions: text, dates, addresses, similarity."""
