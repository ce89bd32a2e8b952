"""Lodeweave: graph and relational analytics over code-shaped data, expressed in PySpark DataFrames."""
