"""Plan helpers shared by the operators: lineage cuts, exact range joins, distributed ranks."""
