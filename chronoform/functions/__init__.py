"""Column functions: scalar expressions without a plan of their own."""
