"""Errors that callers can expect."""


class ContractError(ValueError):
    """Input that does not meet the data contract."""
