"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; remove the folder and the rest of
the library is unaffected.
"""
