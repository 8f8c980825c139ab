"""Part of the vector engine; see README.md."""
