"""Operators for preparing text corpora: one module for each, and the queries that apply them."""
