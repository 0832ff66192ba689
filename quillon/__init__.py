"""Part of the quillon engine."""
