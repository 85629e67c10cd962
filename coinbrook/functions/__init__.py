"""Column functions on money, text and dates."""
