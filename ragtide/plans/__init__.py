"""What plans read."""
