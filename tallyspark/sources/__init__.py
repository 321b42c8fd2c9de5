"""Sources: landed feed pages, ledger snapshots, change messages on the wire, archives and test tables."""
