"""tuturan: speech-corpus preparation, normalisation and scoring as Spark DataFrames."""
