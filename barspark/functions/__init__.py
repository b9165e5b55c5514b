"""Part of the bar engine."""
