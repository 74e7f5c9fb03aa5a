"""Statistics and drift analysis as DataFrame plans."""
