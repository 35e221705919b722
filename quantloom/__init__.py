"""Cross-sectional factor research and large-corpus operators as lazy Spark plans."""
