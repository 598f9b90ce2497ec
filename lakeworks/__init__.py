"""Lakehouse operators for transaction data, written as plain Spark DataFrame functions."""
