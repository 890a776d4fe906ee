"""User-level jobs made of the operators."""
