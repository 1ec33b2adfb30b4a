"""Graph analyses as DataFrame plans."""
