"""DataFrame operators: joins and mappings, segmentation, scoring, the compliance
gate, quality and analytics, enrichment merges and the demo generator."""
