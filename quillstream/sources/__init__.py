"""sources of quillstream."""
