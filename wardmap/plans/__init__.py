"""Query catalogue: operators composed over the given tables."""
