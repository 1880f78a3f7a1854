"""Readers and writers: objectives, line files, runs, rules, state tables."""
