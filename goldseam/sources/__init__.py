"""Where raw and stored tables come from."""
