"""Column builders: vector distances and partition ids."""
