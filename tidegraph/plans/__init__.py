"""How iterative plans run: cutting lineage, supersteps, fixpoints."""
