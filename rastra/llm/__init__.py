"""Operators for building training data from large text tables.

Nothing else in the package imports this subpackage; ``rastra.llm.queries``
holds the queries that apply its operators to the driver's tables.
"""
