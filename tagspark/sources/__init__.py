"""Reading and writing question tables, submissions and fitted models."""
