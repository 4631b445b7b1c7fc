"""Reports and multi-step jobs composed from the operators."""
