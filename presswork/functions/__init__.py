"""Column-level functions: text, URLs, ids, HTML, image bytes."""
