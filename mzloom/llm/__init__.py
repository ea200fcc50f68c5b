"""Training-data operators: ten operators and the queries that apply them."""
