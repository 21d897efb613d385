"""Statement logs, policy tables and their snapshots."""
