"""facetta: Spark-native retrieval analytics over images, descriptors and text."""
