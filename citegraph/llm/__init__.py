"""Operators for training-data preparation at corpus scale, and their queries.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
when it is present.
"""
