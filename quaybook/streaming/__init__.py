"""The same analytics on streams."""
