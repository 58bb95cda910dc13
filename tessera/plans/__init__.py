"""Programs: relations and rules, recursion, transactions, indexes and commands."""
