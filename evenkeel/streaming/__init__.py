"""Progressive recording of finished runs."""
