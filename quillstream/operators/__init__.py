"""operators of quillstream."""
