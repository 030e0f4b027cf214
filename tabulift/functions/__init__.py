"""Schema helpers and column expressions shared by the operators."""
