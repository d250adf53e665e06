"""Training-data operators: the corpus operators and their registered queries."""
