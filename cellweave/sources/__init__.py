"""Text formats, published fixtures, and external tools."""
