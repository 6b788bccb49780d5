"""DataFrame operators: contracts, dedup, graph pruning, features, models, ranks, metrics, statistics, operations."""
