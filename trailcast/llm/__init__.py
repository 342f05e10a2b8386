"""Operators of a training-data pipeline: near-duplicate detection, decontamination,
classifiers, scanners, tokenisation. Nothing else in the library imports this package."""
