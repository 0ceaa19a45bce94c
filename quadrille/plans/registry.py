"""The registered queries over the driver tables, and their SQL."""

from quadrille.plans import abundance, cells, clusterings, contrasts, endpoints, factors, graphs, patterns, rounds, space, storage, streams, units, validation  # noqa: F401
from quadrille.plans.common import QUERIES, SQL

FLAGSHIP = "effect_sizes"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
