"""Usage telemetry analytics for AI coding tools, expressed as Spark DataFrames."""

from usagelake.plans.repository import Analytics, DateRange

__all__ = ["Analytics", "DateRange"]
