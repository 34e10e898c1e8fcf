"""Column functions; none runs Python on the executors."""
