"""All registered queries of the reference's operators and their SQL."""

from tidewave.plans import further, measures, registry, studies

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
flagship = registry.flagship

__all__ = ["ORACLES", "QUERIES", "flagship", "further", "measures", "studies"]
