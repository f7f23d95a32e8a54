"""Operators that prepare training data for language models, and the queries that run them.

Nothing outside this folder imports it.
"""
