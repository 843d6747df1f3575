"""Structured Streaming forms of site detection, clustering and totals."""
