"""Training-data pipeline operators: packing, tokenisation, sharding, scoring, dedup and search."""
