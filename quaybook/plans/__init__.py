"""Reusable plan shapes, registered queries and their SQL counterparts."""
