"""Operators of a training-data pipeline: deduplication, search, scoring, archives, mixing and packing.

One module per operator; ``queries`` registers one query per operator.  Nothing
else in the library imports this subpackage.
"""
