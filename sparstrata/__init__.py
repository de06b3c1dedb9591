"""Sparse triangular systems as Spark jobs: matrices are tables (i, j, v)."""
