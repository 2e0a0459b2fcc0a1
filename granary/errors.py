"""What can go wrong, by kind."""

from __future__ import annotations


class GranaryError(Exception):
    """Root of all errors of the library."""


class ConformanceError(GranaryError):
    """Stored content breaks a rule of the format."""


class SchemaError(GranaryError, ValueError):
    """A specification, a value or a predicate does not fit the schema."""


class ReservedNameError(SchemaError):
    """A name that the format keeps for itself."""


class OversizedStringError(SchemaError):
    """A string takes more bytes than its column has; nothing is ever cut."""


class FillValueError(SchemaError):
    """A fill value is absent, unfit, or lies within the valid range."""


class FilterError(SchemaError):
    """A storage filter that cannot be."""


class StaleIndexError(GranaryError):
    """An index is older than the table."""


class VersionError(GranaryError):
    """The table was written by a later major version."""
