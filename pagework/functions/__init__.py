"""Column functions: URLs, file paths, markup and style-sheet text."""
