"""Fisher records, their factorisation and what to read from it, as Spark jobs; and operators for training corpora."""
