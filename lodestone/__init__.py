"""lodestone: batch preparation and auditing of text corpora on Spark."""
