"""Plans of file operations and whole imports."""
