"""Incremental processing: results that grow as new plans arrive."""
