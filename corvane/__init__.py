"""Conversation analytics and search on Apache Spark."""
