"""Multi-step plans: row order, exact quantiles, keyed look-ups, recipes."""
