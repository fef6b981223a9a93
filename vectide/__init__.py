"""Vector search and vector data processing as Spark DataFrame transformations."""
