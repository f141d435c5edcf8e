"""quire: corpus preparation, chunking, evaluation and retrieval on Spark DataFrames."""

__version__ = "0.1.0"
