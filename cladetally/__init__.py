"""Census and genome-catalogue analytics as Spark DataFrame jobs."""
