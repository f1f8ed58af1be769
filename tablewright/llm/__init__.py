"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Queries and their SQL are in
:mod:`tablewright.llm.queries`.
"""
