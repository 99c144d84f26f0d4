"""What can go wrong, as one family of exceptions."""


class ColumnError(Exception):
    """The base of all errors raised here."""


class UnknownTypeError(ColumnError):
    """A type that has no mapping."""


class OutOfBoundsError(ColumnError, IndexError):
    """A position outside the data."""


class NoElementsError(ColumnError):
    """An operation that needs at least one batch, chunk or row got none."""


class UnsupportedError(ColumnError, NotImplementedError):
    """Something that neither Spark nor this engine can do."""


class SourceError(ColumnError, OSError):
    """A file or message that can't be read."""


class InvalidError(ColumnError, ValueError):
    """Data or arguments that break a rule of the data model."""
