"""Where datoms come from and go to."""
