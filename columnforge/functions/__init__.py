"""Column expressions: rendering, conversion and buffer layout."""
