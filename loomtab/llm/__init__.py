"""Operators for preparing language-model training data.

The numbered operators live in one module each; :mod:`loomtab.llm.queries` registers the
queries that run them over whole tables.  Nothing outside this subpackage imports it.
"""
