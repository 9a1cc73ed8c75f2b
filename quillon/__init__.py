"""Retrieval, matching, audit and lifecycle analytics as DataFrame operators."""
