"""Sources: page tables, search frontier, listing files, derived test listings."""
