"""sitemill: Spark jobs for site content, catalogue and order data."""
