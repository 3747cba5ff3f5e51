"""Operational analytics for queue, workflow and publish/subscribe tables on PySpark."""
