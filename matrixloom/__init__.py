"""matrixloom: annotated matrix stores as Spark DataFrames.

The operations take a SparkSession first: convert, concat, rechunk, sort, plan_append, append, add_layer. Repo versions stores;
register_source adds input kinds; config holds the configuration objects.
"""

from .errors import ConversionError, LoomError, RepoError, StorageError, ValidationError

__version__ = "0.1.0"
_OPS = ("add_layer", "append", "concat", "convert", "plan_append", "rechunk", "sort", "AppendPlan")
__all__ = ["ConversionError", "LoomError", "OpResult", "Repo", "RepoError", "StorageError", "Store", "ValidationError", "detect_format", "from_arrays", "open_source", "register_source", *_OPS]


def __getattr__(name: str):
    """Imports on first use, so that the command line answers --help without Spark."""
    if name in _OPS:
        from .plans import ops as module
    elif name == "Repo":
        from .plans import repo as module
    elif name in ("Store", "OpResult"):
        from .plans import store as module
    elif name in ("register_source", "detect_format", "open_source"):
        from .sources import registry as module
    elif name == "from_arrays":
        from .sources import annotated as module
    else:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(module, name)
