"""Incremental prefix emission for live event streams."""
