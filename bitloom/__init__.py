"""Binary quadratic models as Spark tables: build, check, score and compare."""

from bitloom.schemas import KEY, Batch

__all__ = ["KEY", "Batch"]
