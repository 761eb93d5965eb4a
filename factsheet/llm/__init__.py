"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and SQL, and ``__spark_entry__`` adds them when it can be imported.
"""
