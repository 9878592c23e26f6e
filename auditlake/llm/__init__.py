"""Operators for preparing language-model training text.

Nothing else in the library imports this package.  Each module holds one
operator; :mod:`auditlake.llm.queries` binds them to the test tables.
"""
