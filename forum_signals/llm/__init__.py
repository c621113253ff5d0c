"""Operators for preparing large text collections for language-model training.

Nothing outside this package imports it; ``queries.py`` registers one query per operator.
"""
