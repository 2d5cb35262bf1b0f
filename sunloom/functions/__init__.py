"""Column expressions: clear-sky index, blending and caps, basis functions, snapping, time features."""
