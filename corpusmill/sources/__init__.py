"""Readers and writers with fixed schemas; unreadable rows become rejects, never silent losses."""
