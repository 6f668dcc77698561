"""Column helpers: pure Catalyst expressions, no Python on the executors."""
