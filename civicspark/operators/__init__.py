"""DataFrame -> DataFrame operators: schema, payloads, merge, indicators."""
