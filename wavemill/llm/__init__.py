"""Corpus operators for training-data pipelines.

Thirteen operators, each in a module of its own, plus the queries that apply
them to the driver tables (``entries``).  Nothing outside this package
imports it.
"""
