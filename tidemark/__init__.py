"""tidemark: incremental load, reconciliation and run-history operators for PySpark."""

__version__ = "0.1.0"
