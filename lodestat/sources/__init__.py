"""Reading delimited text without interpreting it, and writing tables."""
