"""Retrieval and hygiene of document corpora on Spark: BM25F ranking, catalogues, path rules and rewrites."""
