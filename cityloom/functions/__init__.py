"""Column functions. All of them build native Spark expressions unless their doc says otherwise."""
