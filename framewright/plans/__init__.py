"""Entry points that combine the operators: search, curate, refilter, merge, export."""
