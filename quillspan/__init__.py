"""quillspan: retrieval, answer evaluation and training-data preparation as Spark jobs."""
