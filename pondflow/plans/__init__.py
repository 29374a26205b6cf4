"""Composite queries (balances, forecasts) and the driver query catalog."""
