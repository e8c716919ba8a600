"""Where graphs come from and where they are kept."""
