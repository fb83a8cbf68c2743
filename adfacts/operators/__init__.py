"""Table logic: everything that groups, joins, explodes or calls a model."""
