"""Operators: ``DataFrame → DataFrame`` functions over user-chosen columns."""
