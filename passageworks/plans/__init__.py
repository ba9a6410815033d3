"""The two flows of the library: ingesting a corpus and preparing answers."""
