"""Operators of a large-scale training-data pipeline (language ID, extraction,
deduplication, packing, token counts, chat formatting, quality rules).

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
