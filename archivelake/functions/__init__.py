"""Scalar expressions: text, hashes and vectors."""
