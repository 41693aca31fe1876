"""rolodexter: contact-data quality and CRM analytics on Spark DataFrames."""
