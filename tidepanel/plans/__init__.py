"""Compositions and the registered queries."""
