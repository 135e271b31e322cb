"""Choice of search method, settings and the registered queries."""
