"""Operators for training-data pipelines: cleaning, deduplication, decontamination,
tokenization and packing. Nothing outside this subpackage imports it."""
