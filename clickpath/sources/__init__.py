"""Scans, the fixture adapter, event cleaning and sinks."""
