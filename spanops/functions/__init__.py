"""Column expressions: predicates, scalars, aggregates and quantiles."""
