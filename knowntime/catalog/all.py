"""Import every module that registers queries."""

from knowntime.catalog import features, ingest, ledgers, market, models, people, rules, scores, streams  # noqa: F401
from knowntime.catalog.registry import ORACLES, QUERIES  # noqa: F401
