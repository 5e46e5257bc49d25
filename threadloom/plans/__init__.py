"""Named queries over the driver tables, each beside its SQL twin."""

from . import corpus, evals, ontology, records, search, texts
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "evals", "ontology", "records", "search", "texts"]
