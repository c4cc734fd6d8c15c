"""Readers: nested JSON documents, snapshot directories, tables and optional tables."""
