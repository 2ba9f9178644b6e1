"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; ``registry`` derives the fixed query results from them.
"""
