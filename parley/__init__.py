"""Conversation and event-timeline analytics as Spark jobs."""
