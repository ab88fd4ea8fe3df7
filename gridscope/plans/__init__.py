"""Compositions of operators: the analyses users call, and the catalogue of
queries over the driver tables that the correctness check runs."""
