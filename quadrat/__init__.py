"""Quadrat: analytics over object-detection datasets and experiments, on PySpark."""
