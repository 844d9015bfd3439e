"""Column expressions and mergeable accumulators."""
