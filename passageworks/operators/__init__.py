"""DataFrame operators: chunking, embedding, retrieval, lineage and conversation shaping."""
