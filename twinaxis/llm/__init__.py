"""Operators for preparing training data at cluster scale.

Nothing outside this package imports it; the folder can be removed and the
rest of the library keeps working.
"""
