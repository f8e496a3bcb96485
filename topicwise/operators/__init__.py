"""Operators over RAW, RECORD and session frames. Each takes and returns DataFrames."""
