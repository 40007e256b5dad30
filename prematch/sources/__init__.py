"""Reading, shaping and writing tables."""
