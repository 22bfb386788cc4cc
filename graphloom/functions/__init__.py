"""graphloom."""
