"""All queries over the reference's own operators: name -> plan, and the SQL that must give the same rows."""

from __future__ import annotations

from strandlake.plans import contexts, counts, coverage, expression, features, hierarchy, models, more, reads, records, reports, sequences, spans, structures
from strandlake.plans.common import Query

_MODULES = (coverage, spans, sequences, structures, records, reads, features, contexts, counts, expression, reports, hierarchy, models, more)
QUERIES: dict[str, Query] = {name: f for m in _MODULES for name, f in m.query.queries.items()}
ORACLE_SQL: dict[str, str] = {name: text for m in _MODULES for name, text in m.query.sql.items()}
