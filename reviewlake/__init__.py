"""Code scanning and change review as Spark DataFrame transformations."""
