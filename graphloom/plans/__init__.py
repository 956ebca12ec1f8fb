"""Plan helpers: written intermediate tables, iteration, derived graphs and registered queries."""
