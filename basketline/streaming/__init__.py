"""The row-local cleaning stages applied to a stream of arriving files."""
