"""See the package README for the operator list."""
