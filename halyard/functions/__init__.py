"""Part of halyard."""
