"""Table loading and shared intermediate storage."""
