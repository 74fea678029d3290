"""The library's queries over the driver's tables and their SQL."""

from tessera.plans import collection, engine, measurement, records

MODULES = (measurement, collection, engine, records)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
