"""Reading documents from files, and writing them."""
