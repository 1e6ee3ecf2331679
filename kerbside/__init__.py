"""Kerbside: street exposure analytics expressed as Spark DataFrame operators."""
