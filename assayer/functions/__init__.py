"""Scalar building blocks: transforms, row aggregators, similarities, text functions, the registry."""
