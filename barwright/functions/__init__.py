"""Part of barwright."""
