"""Readers, writers, the score store and the dataset catalogue."""
