"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from quillmark.plans import cohort_queries, evidence_queries, style_queries, text_queries, transfer_queries  # noqa: F401  they register on import
from quillmark.plans._base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "flagship_style_attribution"
