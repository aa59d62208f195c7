"""Edge lists, node features, snapshots and run records."""
