"""Operators for preparing text corpora: matching, segmentation, redaction, encoding, packing, repair."""
