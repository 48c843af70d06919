"""Operators for preparing large language-model training corpora.

Ten operators, each by its own method, in one module each; ``queries`` holds the
registered queries and their SQL. Nothing outside this package imports it.
"""
