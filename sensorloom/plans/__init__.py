"""Compositions of operators: the batch refresh and the catalog of named queries."""
