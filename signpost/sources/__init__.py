"""Tables read and written: articles, routes, runs."""
