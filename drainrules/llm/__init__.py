"""Operators for preparing text corpora at scale (see README, section "Corpus operators")."""
