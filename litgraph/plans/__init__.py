"""End-to-end plans, test-table derivations and the query catalog."""
