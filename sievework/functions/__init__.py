"""Column functions: text hygiene, contract predicates, time splits and buckets."""
