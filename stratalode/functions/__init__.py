"""Part of the stratalode engine."""
