"""Operators for training data: dedup, classifiers, counts, secrets, tokenizer, LM, decontamination, search.

Nothing else in the library imports this subpackage.
"""
