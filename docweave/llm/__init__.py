"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
