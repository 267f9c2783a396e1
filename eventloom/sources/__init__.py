"""Where media and library tables come from."""
