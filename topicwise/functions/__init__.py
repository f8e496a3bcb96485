"""Column functions: text, headers, JSON payloads, lag display."""
