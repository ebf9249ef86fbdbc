"""DataFrame → DataFrame operators (filters, aggregates, top-k, joins, cleaning)."""
