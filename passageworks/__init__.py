"""Text-corpus preparation and exact vector retrieval as Spark DataFrame operators."""
