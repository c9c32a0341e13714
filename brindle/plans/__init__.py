"""Plans: the logical tree of a SELECT, its physical choices, and their lowering to DataFrames."""
