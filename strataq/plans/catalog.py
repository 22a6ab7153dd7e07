"""All queries of the core, with their SQL; modules register theirs here."""

from __future__ import annotations

from strataq.plans import evaluation, ingest, pages, search

QUERIES = {**pages.QUERIES, **ingest.QUERIES, **search.QUERIES, **evaluation.QUERIES}
SQL = {**pages.SQL, **ingest.SQL, **search.SQL, **evaluation.SQL}
