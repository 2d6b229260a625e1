"""Where records come from: memory, JSON files, paged interfaces."""
