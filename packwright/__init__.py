"""Tokenizing, packing, shuffling and scoring of text tables on Spark."""
