"""Operators over assets, vectors and rank lists: DataFrame in, DataFrame out, nothing collected midway."""
