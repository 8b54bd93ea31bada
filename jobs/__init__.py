"""Jobs for the command line, and the queries that run them."""
