"""Training-data operators: filtering, deduplication, scoring, mixing and formatting of corpora.

Nothing outside this folder imports it; `queries.py` lists its queries for the entry module.
"""
