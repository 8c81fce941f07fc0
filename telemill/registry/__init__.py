"""Named queries over the shared tables and the SQL that checks them."""
