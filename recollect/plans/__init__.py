"""Named query plans over the standard tables."""
