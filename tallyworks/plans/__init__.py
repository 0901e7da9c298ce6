"""Multi-table jobs that chain the operators and write their results."""
