"""Part of textloom."""
