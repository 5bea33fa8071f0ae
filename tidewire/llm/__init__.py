"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries`` registers its
operators for the driver.
"""
