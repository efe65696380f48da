"""The catalog of report queries, and the SQL that each is compared with."""

from __future__ import annotations

from ..streaming import queries as stream_queries
from . import candidate_reports, crawl_reports, keyword_reports, log_reports, match_reports, monitor_reports, page_rules, pattern_reports, provider_reports, quality_reports, search_reports

_PARTS = [search_reports, log_reports, crawl_reports, keyword_reports, monitor_reports, page_rules, pattern_reports, quality_reports, match_reports, candidate_reports, provider_reports, stream_queries]
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
