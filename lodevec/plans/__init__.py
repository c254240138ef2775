"""Options, knobs, budgets and cost formulas."""
