"""Maritime spill forensics and corpus preparation as Spark DataFrame jobs."""
