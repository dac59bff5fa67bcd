"""Operators for training-data text: shared spans, token ids, mixtures, template residue.

Nothing outside this subpackage imports it.
"""
