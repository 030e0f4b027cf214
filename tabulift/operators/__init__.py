"""The table operators, each a function from DataFrame to DataFrame (or a fitted object that transforms one)."""
