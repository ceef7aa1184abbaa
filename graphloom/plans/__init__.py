"""Planning helpers: shared storage for cut lineage and bounded collects."""
