"""Directed-cycle analytics on Spark: edge tables in, feedback vertex sets and graph structure out."""
