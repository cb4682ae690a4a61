"""Reports and tables built from the operators."""
