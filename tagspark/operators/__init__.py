"""Relational operators: lookups, ordering, duplicates, tag statistics, features, models."""
