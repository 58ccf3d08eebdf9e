"""Ready-made plans: fixtures over the driver's tables, registered queries."""
