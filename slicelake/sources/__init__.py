"""Readers: lifecycle events, CSV objects, logs, control tables, generated rows."""
