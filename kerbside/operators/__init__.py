"""DataFrame -> DataFrame operators: lookups, calendar, nearest postcodes, merges, change gate, recents."""
