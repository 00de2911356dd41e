"""Reading and writing of the tables."""
