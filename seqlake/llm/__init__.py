"""Operators for preparing language-model training data.

Self-contained: nothing outside this subpackage imports it.
"""
