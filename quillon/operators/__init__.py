"""Events to entries, retrieval, the hashed store, compaction, rendering."""
