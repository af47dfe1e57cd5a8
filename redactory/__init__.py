"""Governed de-identification of tables and streams on Spark."""

from .policy import Policy  # noqa: F401
