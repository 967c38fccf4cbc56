"""A Spark-native toolkit to read feature files, score, evaluate, train and serve over DataFrames."""
