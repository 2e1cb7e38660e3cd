"""Evidence-to-panel analytics as PySpark DataFrame operators."""
