"""DataFrame -> DataFrame operators on postings and run logs."""
