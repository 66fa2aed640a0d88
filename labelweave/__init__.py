"""Training, judging and applying text-document classifiers as Spark jobs."""
