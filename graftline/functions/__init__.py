"""Functions of single documents: text to values, values to text, and columns of both."""
