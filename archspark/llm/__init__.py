"""Training-data operators: one module per operator, `queries` binds them to the test tables."""
