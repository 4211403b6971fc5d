"""DataFrame operators: aggregates, joins, change, flows, reshaping, models, geography."""
