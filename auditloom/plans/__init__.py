"""Plan shapes shared by operators: skew handling, ordered series, fixpoints."""
