"""Analytics operators: typed report DataFrames + client config in, DataFrame out."""
