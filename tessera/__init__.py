"""tessera: analytics over loan-disclosure corpora, written for Spark."""
