"""Table operators: DataFrame in, DataFrame out, nothing is executed here."""
