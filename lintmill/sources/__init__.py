"""Corpus scans, catalogue tables and sinks."""
