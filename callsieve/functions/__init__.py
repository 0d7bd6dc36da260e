"""Column builders: text and JSON in, Column out."""
