"""Tables, catalog, segments and snapshots."""
