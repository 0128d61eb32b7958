"""DataFrame operators: thermodynamics, stores, joins, training, design, geometry, sampling."""
