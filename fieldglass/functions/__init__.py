"""Column expressions: cell semantics, formatting, byte access and JSON text."""
