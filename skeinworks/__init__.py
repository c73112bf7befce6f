"""Spark-first preparation of scientific image collections and their records.

Every operator takes and returns a DataFrame. Relational work is written as
Catalyst expressions; only pixel-coupled mathematics runs in Arrow-batched
NumPy kernels.
"""
