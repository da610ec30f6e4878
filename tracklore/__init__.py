"""tracklore: dialogue-track analytics as Spark DataFrame operators."""
