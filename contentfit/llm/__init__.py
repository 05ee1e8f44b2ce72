"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` applies
them to the whole tables.  Nothing outside this subpackage imports it.
"""
