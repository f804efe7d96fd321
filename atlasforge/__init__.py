"""Catalog, archive and volume analytics expressed as Spark plans."""
