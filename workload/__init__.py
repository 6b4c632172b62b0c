"""The engine's tables mapped from the given ones, and one checked query per operator."""
