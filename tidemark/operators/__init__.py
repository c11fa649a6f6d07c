"""Graph, ranking, trend, delta, title and vector operators."""
