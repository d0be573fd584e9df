"""Training-data operators: packing, joins, dedup, archives, quality, sharding and tokenising."""
