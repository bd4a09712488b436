"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from plexum.plans import alignments, commands, curation, expression, images, ordered, screens, statistics, summaries, texts, vectors
from plexum.plans.base import ORACLES, QUERIES

FLAGSHIP = "cell_gene_pivot"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "alignments", "commands", "curation", "expression", "images", "ordered", "screens", "statistics", "summaries", "texts", "vectors"]
