"""Operators over texts and source files for training corpora."""
