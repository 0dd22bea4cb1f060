"""lexiloom: corpus analytics and counting-based word embeddings on PySpark."""

__version__ = "0.1.0"
