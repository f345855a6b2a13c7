"""A PySpark engine for document processing and retrieval."""
