"""Errors by the part of the chain that raises them."""

from __future__ import annotations


class DataSourceError(RuntimeError):
    """Files, headers or cells that no panel can be made of."""


class DataValidationError(ValueError):
    """Problems that the quality report lists."""


class SplitError(ValueError):
    """Shares, or a series too short for them."""


class FeatureError(ValueError):
    """Frames without unique keyed stamps, or reaches that make no sense."""


class TargetError(ValueError):
    """Horizons that no row of a frame can look ahead by."""


class SequenceError(ValueError):
    """Lengths, columns or runs that give no window."""


class ScalerError(RuntimeError):
    """Statistics that are missing, or that would divide by zero."""


class NaiveModelError(ValueError):
    """A season too short, or rows whose stamp of last season is not there."""


class ForecastError(ValueError):
    """Learners without a name, or rows without their features."""


class RegistryError(RuntimeError):
    """Versions that are not there, or models that cannot be stored."""
