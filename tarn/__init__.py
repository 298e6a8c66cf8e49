"""A Spark-native engine for retrieval, conversation memory, storage planning and diagnostics."""
