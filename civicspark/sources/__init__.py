"""Scans (catalog CSVs, line lists, error logs, tables) and sinks."""
