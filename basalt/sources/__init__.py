"""Tables, table functions, catalog rows and sinks."""
