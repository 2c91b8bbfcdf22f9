"""Point-in-time cross-sectional panel analytics on PySpark."""
