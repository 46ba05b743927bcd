"""Arrays, and the operators on them."""
