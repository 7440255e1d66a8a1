"""DataFrame operators: every one takes its key, time and dimension columns as parameters."""
