"""Rules, reports and the registered queries."""
