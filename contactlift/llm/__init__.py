"""Operators of a training-data pipeline: mixing, decontamination, URL and licence filters, personal data,
HTML extraction, language-model scores, quality rules, near duplicates and repeated passages.

Nothing else in the library imports this subpackage.
"""
