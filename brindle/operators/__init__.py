"""Match operators: DataFrame in, DataFrame out, on built-in functions only."""
