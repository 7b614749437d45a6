"""All registered queries of the library, with their SQL."""

from . import queries_depth, queries_fields, queries_merging, queries_ranking, queries_sources  # noqa: F401
from .queries import ORACLES, QUERIES  # noqa: F401
