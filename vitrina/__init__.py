"""Retail sell-through analytics as Spark DataFrame jobs."""
