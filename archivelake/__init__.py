"""A semantic index over archives, and operators for training corpora, on Spark."""
