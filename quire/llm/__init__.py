"""Training-data operators: quality rules, token counts, toxicity, near
duplicates, HTML extraction, packing, repeated passages, web archives, chat
formatting and benchmark decontamination.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
named queries and their SQL.
"""
