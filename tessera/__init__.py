"""A relational rule engine on Spark: typed relations, rules, recursion, transactions, epochs and a command language."""
