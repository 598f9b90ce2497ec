"""Column helpers; every one stays a JVM expression."""
