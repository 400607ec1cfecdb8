"""Raw landings, tables and output files."""
