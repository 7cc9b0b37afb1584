"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any failure of the engine."""


class NotFound(EngineError):
    """No such episode, entity or run."""


class InvalidInput(EngineError, ValueError):
    """A value or file that makes no sense."""


class ConfigError(EngineError):
    """An unknown or ill-typed setting."""


class StoreError(EngineError):
    """A snapshot that can't be read or written."""


class ExtractionError(EngineError):
    """An extractor failed."""


class ProviderError(EngineError):
    """A model provider failed."""


class Conflict(EngineError):
    """Two writers at once."""
