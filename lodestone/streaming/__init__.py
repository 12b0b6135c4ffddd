"""Queue, status and window processing over streams."""
