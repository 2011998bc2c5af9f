"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Every module holds one operator;
``registry`` lists the queries built from them.
"""
