"""Error classes, one per stage of the work."""


class LatelaneError(Exception):
    """Base of every error raised by this package."""


class SourceError(LatelaneError):
    """An input could not be read or holds no usable rows."""


class StoreError(LatelaneError):
    """A stored table is missing or fails its health check."""


class TrainingError(LatelaneError):
    """A model cannot be trained on the given rows."""


class ScoringError(LatelaneError):
    """A model bundle is missing or cannot be applied."""
