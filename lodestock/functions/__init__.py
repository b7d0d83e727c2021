"""Part of lodestock."""
