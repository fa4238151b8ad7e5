"""Operators for training-data pipelines over the ``documents`` and ``pages`` tables.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it
is present.
"""
