"""End-to-end plans: operators put together over a set of tables."""
