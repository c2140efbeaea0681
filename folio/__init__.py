"""Folio: document analytics as Spark jobs."""
