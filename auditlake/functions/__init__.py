"""Scalar expressions, and table functions for what needs scan state."""
