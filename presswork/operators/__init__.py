"""DataFrame-level operators: catalog queries, links, extraction, de-dup, repair."""
