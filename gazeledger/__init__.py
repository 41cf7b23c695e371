"""Access-audit analytics as Spark DataFrame jobs."""

from gazeledger.params import AuditParams

__all__ = ["AuditParams"]
