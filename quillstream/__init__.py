"""quillstream: a Spark-first engine for news monitoring and document processing."""
