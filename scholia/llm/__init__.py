"""Training-data operators: the thirteen corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
