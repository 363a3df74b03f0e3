"""Replication, quality and governance of tables as Spark DataFrame functions."""
