"""gnomon: repository intelligence and corpus preparation as PySpark jobs."""
