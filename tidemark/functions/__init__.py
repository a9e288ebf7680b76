"""Column expressions: time units, geodesy, model basis functions."""
