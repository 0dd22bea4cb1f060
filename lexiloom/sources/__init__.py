"""Reading and writing tables and interchange files."""
