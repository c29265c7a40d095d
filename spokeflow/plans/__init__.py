"""Plan helpers: where lineage is cut, and how sizes are checked before a broadcast."""
