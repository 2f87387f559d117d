"""plans of quillstream."""
