"""feedweave: content-feed processing as Spark DataFrame operators.

Subpackages: ``functions`` (column expressions), ``sources`` (scans),
``operators`` (DataFrame operators), ``plans`` (the daily job, the query
registry and its DuckDB oracle), ``streaming`` (incremental jobs).
"""

from feedweave.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
