"""Training-data operators: deduplication, decontamination, mixing, scoring,
tokenisation and archives, each as Spark jobs over whole tables."""
