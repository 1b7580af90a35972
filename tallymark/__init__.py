"""Label-compliance analytics expressed as Spark DataFrame jobs."""

from tallymark.session import build_session

__all__ = ["build_session"]
