"""Operators that prepare language-model training data.

Nothing outside this folder imports it, except the optional hook in ``__spark_entry__``.
"""
