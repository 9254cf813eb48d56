"""The engine's exceptions."""


class LoomError(RuntimeError):
    """Any failure the engine reports."""


class ConversionError(LoomError):
    """An input can't be read or written as asked."""


class StorageError(LoomError):
    """A store or target can't be opened, written or verified."""


class ValidationError(LoomError, ValueError):
    """Arguments, configuration or schemas don't fit."""


class RepoError(LoomError):
    """A versioned repository refuses an operation."""
