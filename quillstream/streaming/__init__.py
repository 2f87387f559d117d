"""streaming of quillstream."""
