"""Column expressions: names, lineages, predicates, classifications, measures."""
