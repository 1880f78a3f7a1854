"""Operators on candidate tables: batch semantics, run-log metrics, sets, diversity, Pareto ranks."""
