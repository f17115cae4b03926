"""DataFrame operators. Every one takes column names or columns and is lazy."""
