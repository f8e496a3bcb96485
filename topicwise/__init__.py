"""Kafka record inspection, dead-letter triage and tracing as Spark DataFrame operators."""
