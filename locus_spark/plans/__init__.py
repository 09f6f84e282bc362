"""Plan helpers: lineage cuts in the shared folder and checked broadcasts."""
