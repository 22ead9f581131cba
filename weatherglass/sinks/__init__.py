"""Where records, models, series and logs are written to and read back from."""
