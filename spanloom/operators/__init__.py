"""DataFrame -> DataFrame operators, grouped by subject."""
