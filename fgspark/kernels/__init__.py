"""Inference in one graph, in numpy; grouped Spark jobs run these per graph."""
