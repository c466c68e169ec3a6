"""Every operator over the sample data, and the SQL that states its expected result."""
