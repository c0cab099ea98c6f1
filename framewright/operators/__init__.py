"""DataFrame -> DataFrame operators over the record table."""
