"""Streams of events: totals by window, and plans kept up to date."""
