"""Data-trust audit and zero-sum levelling, built from Spark DataFrame operators."""
