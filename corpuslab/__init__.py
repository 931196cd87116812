"""corpuslab: a PySpark-native engine for auditing labelled corpora and the experiments run on them."""
