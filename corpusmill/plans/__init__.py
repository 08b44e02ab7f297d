"""Named queries over a directory of tables, with the SQL that states the same result."""
