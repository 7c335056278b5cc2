"""Operators for building training corpora: scans, fixity, tokenisers, extraction,
sharding, quality rules, language ID, decontamination and near-duplicate removal.

Nothing else in the library imports this subpackage.
"""
