"""tomegrid: document ingest, chunking, vector retrieval and corpus preparation on PySpark."""

__version__ = "0.1.0"
