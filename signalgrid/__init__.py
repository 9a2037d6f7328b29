"""Situational-signal analytics as Spark DataFrame operators."""
