"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it. ``queries.py`` names its queries,
each operator lives in a module of its own.
"""
