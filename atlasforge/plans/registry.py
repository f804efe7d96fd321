"""All registered queries of the reference's operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from . import catalog_queries, estate_queries, manifest_queries, more_queries, public_queries, registry_queries, source_queries, workset_queries

QUERIES: dict = {**catalog_queries.QUERIES, **estate_queries.QUERIES, **manifest_queries.QUERIES, **public_queries.QUERIES, **registry_queries.QUERIES, **source_queries.QUERIES, **more_queries.QUERIES, **workset_queries.QUERIES}
ORACLES: dict = {**catalog_queries.ORACLES, **estate_queries.ORACLES, **manifest_queries.ORACLES, **public_queries.ORACLES, **registry_queries.ORACLES, **source_queries.ORACLES, **more_queries.ORACLES, **workset_queries.ORACLES}
