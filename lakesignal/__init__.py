"""Media-signal analytics as DataFrame plans."""
