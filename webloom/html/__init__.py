"""HTML in plain Python: a tree, selectors, Markdown and page extraction. No Spark in here."""
