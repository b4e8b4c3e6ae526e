"""DataFrame operators: reconciliation, series, point in time, retrieval, statements."""
