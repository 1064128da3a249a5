"""Query building over a foreign-key graph, and the registered queries."""
