"""Readers and writers of the stored tables, and the views over the test tables."""
