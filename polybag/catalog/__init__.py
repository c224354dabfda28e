"""Every operator as a named query over the driver's tables, with the SQL to check it."""
