"""Where reports and snapshots are written to."""
