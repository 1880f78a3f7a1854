"""Training-data operators: extraction, filters, deduplication, mixing, models.

Nothing outside this subpackage imports it; its queries live in
:mod:`assayer.llm.queries`.
"""
