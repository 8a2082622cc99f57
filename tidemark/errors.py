"""Errors raised while an operator is being built (never per row)."""


class PlanError(ValueError):
    """An op is malformed or does not fit the table it is applied to."""


class MissingColumnError(PlanError):
    """One or more named columns are not in the table."""

    def __init__(self, missing, available):
        self.missing = list(missing)
        super().__init__(f"Missing columns {self.missing}; table has {list(available)}")


class UnknownOperatorError(PlanError):
    """No operator is registered under the given name."""
