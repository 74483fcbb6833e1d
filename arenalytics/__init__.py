"""Player and server analytics expressed as Spark DataFrame transformations."""
