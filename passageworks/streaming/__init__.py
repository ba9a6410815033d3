"""The ingest flow over files as they arrive."""
