"""Operators put together: the end-to-end run and the registered queries."""
