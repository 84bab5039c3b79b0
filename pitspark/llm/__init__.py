"""Operators over text corpora: cleaning, deduplication, mixing, packing and scoring.

Nothing else in the library imports this subpackage.
"""
