"""Spark-native analytics over temporal contact logs: tables in, tables out."""

from recontact.policy import DAY, HOUR, Policy
from recontact.session import configure, checkpointed

__all__ = ["DAY", "HOUR", "Policy", "configure", "checkpointed"]
