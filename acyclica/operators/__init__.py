"""Graph operators over edges(src, dst): profiles, edits, structure, reductions, rankings, solvers."""
