"""tessera: record linkage and text-corpus preparation as lazy PySpark plans."""

__version__ = "0.1.0"
