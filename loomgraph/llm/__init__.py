"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

`queries()` and `oracle_sql()` are what `__spark_entry__.py` adds when the subpackage is there.
"""

from .entries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
