"""Operators of a training-data pipeline over the documents table.

One module per operator, each with its own interface and an ``op<N>`` query over whole
tables in ``catalog``. Nothing else in the library imports this package.
"""
