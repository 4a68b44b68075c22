"""Knowledge-graph analytics over document corpora, written as Spark DataFrame plans."""
