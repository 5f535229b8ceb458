"""Training-data operators: decontamination, deduplication, scoring, filtering,
mixing, chat formatting, token counts and packing.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and their SQL.
"""
