"""Scalar functions, as Columns where Spark has the parts and as plain Python where not."""
