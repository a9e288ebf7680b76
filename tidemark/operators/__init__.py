"""Relational and training-data operators: DataFrame in, DataFrame out."""
