"""Jobs composed of several operators, the derived fixtures and the query registry."""
