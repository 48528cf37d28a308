"""Windowed aggregation of client metrics: types, transforms, pipelines and the rules that choose them."""
