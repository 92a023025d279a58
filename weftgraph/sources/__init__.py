"""sources of the document graph."""
