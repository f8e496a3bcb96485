"""Where records come from: Kafka, recorded sessions, message bodies."""
