"""The training-data queries and their SQL."""

from . import decontamination, exact_dedup, licenses, line_dedup, mixing, quality, sharding, simhash, token_counts, toxicity

MODULES = (simhash, mixing, toxicity, exact_dedup, quality, line_dedup, token_counts, decontamination, licenses, sharding)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
