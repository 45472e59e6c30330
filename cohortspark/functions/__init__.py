"""Column-level building blocks: NULL rules, date arithmetic and status labels."""
