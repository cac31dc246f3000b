"""Operators of a training-data pipeline over document, page and label tables.

Nothing outside this subpackage imports it; ``stratalog.llm.queries`` holds the
registered queries of its ten operators.
"""
