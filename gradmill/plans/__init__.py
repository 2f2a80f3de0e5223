"""All registered queries of the engine's own operators, and their SQL."""

from gradmill.plans import catalogue, oracles, scans

QUERIES = catalogue.QUERIES | scans.QUERIES
ORACLES = oracles.ORACLES | scans.ORACLES
