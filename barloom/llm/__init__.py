"""Operators for large training-data pipelines. Nothing else in barloom imports this package."""
