"""Operators of a pipeline that prepares training text, and their registered queries."""
