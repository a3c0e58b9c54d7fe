"""parley: a Spark-native engine for building and scoring labelled discussion-thread datasets."""
