"""Relational operators over edges(src, dst, w), nodes(id) and long vectors (id, pos, val)."""
