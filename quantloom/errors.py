"""Errors of the engine."""


class FactorError(ValueError):
    """An input or option that an operator can't work with."""


class NonMatchingTimezoneError(FactorError):
    """Factor and price dates aren't of the same kind or zone."""


class MaxLossExceededError(FactorError):
    """Cleaning dropped a larger share of the rows than allowed."""
