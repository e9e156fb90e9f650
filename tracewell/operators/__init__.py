"""DataFrame to DataFrame operators: voting, graphs, similarity joins, aggregates and path decoding."""
