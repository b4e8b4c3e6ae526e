"""Column functions: labels, numbers, units, citations, periods, arrays."""
