"""Operators for preparing training data at large scale.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; ``corpus_pipeline`` at the repository top chains five.
"""
