"""Element-wise functions of numbers and strings."""
