"""Training-corpus preparation expressed as Spark DataFrame operators."""
