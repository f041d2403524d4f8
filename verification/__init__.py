"""Every operator as a query over the test tables, with an independent SQL query to compare against."""
