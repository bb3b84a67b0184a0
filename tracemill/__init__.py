"""Agent-session analytics and data processing as PySpark DataFrame operators."""
