"""Jobs composed of operators, and the query catalogue with its SQL twins."""
