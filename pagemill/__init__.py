"""pagemill: document analytics on PySpark (spans, lines, blocks, pages, chapters)."""
