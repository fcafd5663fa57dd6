"""Training-data operators: each module holds one operator, `queries` the registered queries."""
