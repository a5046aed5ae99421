"""Tables in and out, and shipping this package to executors."""
