"""Plans, reports and the registered queries."""
