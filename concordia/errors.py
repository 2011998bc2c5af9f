"""Errors, raised when a plan is made wherever the plan alone tells."""


class ConcordiaError(Exception):
    """Any error of this library."""


class DataError(ConcordiaError, ValueError):
    """Data that can't be used as it is."""


class ColumnError(DataError):
    """A column that is missing or has the wrong type."""


class FormatError(DataError):
    """Roles that name no layout, or more than one."""


class NonFiniteError(DataError):
    """Missing, NaN or infinite values under the policy ``raise``."""


class ValueRangeError(DataError):
    """Prices that aren't positive, quantities that are negative, choices outside their menu."""


class DuplicateError(DataError):
    """Several rows for one user, time and item."""


class MetricError(ConcordiaError, ValueError):
    """A metric that isn't known."""
