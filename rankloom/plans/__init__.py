"""Questions asked of a songs table, and their binding to the test tables."""
