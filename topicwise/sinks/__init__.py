"""Where records go: Kafka or files, sessions, exports, replays."""
