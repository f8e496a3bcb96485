"""Structured Streaming jobs: tail, alerts, throughput, recent events, capture, live traces, lag refresh."""
