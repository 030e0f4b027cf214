"""Reading tables and persisting models."""
