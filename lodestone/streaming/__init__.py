"""Event-time windows and running counters; the same functions serve streams and tables."""
