"""The analytical queries over the corpus relations, and the SQL that each is compared with."""

# The first one registers light queries first; queries register in the order of these imports.
from . import quality  # isort: skip
from . import annexes, benchmark, corpus_views, exchange, extraction, gaps, outcomes, promotion, reports, scenarios, sheets, snapshot, standardise, styles, totals, watch
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "annexes", "benchmark", "corpus_views", "exchange", "extraction", "gaps", "outcomes", "promotion", "quality", "reports", "scenarios", "sheets", "snapshot", "standardise", "styles", "totals", "watch"]
