"""Column builders: geometry, classification, text."""
