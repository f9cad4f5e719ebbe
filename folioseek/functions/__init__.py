"""Text functions as columns, with plain Python forms where a query string is handled."""
