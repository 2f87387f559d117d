"""functions of quillstream."""
