"""Column functions and custom scalars."""
