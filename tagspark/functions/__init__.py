"""Column functions: text cleaning, tokens, hashing and losses."""
