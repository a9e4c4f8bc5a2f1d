"""Scalar and frame helpers."""
