"""Plan shapes shared by the operators: skewed joins, split windows, lineage cuts."""
