"""Conversation-memory analytics as Spark tables and streams."""
