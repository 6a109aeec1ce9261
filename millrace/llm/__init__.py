"""Operators for preparing training data at scale, each in its own module.

Nothing outside this subpackage imports it.
"""
