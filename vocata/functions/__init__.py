"""Part of the vocata engine."""
