"""Text simplification analytics on Spark."""
