"""Datasets of the bronze, silver and gold layers, and the graph that runs them."""
