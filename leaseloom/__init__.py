"""Lease-book analytics as Spark DataFrame operators."""
