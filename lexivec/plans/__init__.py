"""Whole queries: retrieval legs, fusion, reranking, filters and how results are shown."""
