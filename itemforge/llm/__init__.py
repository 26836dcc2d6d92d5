"""Training-data operators: each module holds one operator, its digest query and, where SQL can say it, the SQL twin."""
