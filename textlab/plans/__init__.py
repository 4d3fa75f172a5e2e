"""Registered queries: the operators bound to tables, each with an equivalent SQL text."""
