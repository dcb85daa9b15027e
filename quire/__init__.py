"""Books, pages, sections and cards as ordered DataFrames."""
