"""Personal-archive knowledge and retrieval as Spark DataFrame transformations."""
