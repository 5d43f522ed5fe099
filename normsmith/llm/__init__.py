"""Operators and corpus pipeline stages for building training data.

Nothing else in the library imports this package; ``queries.py`` registers
its queries and ``__spark_entry__`` adds them when the package is present.
"""
