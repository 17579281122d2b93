"""millrace: SQL analytics over star and snowflake data, planned and run by Spark."""

from millrace.plans.engine import Engine
from millrace.session import session

__all__ = ["Engine", "session"]
