"""Column functions: text, URLs, dates, vectors, keys."""
