"""Column helpers; plain Spark SQL expressions, usable inside any DataFrame job."""
