"""Training-data operators: packing, chat formatting, tokenising, resharding,
URL rules, toxicity, vector search and de-duplication.

Nothing outside this folder imports it; `queries.py` holds the registered
queries and their SQL twins.
"""
