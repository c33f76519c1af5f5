"""Eligibility and entitlement analytics as Spark DataFrame jobs."""
