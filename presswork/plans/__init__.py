"""How a plan is laid out: skew handling, paging, lineage cuts, site rules."""
