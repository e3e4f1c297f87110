"""corpusloom: a PySpark-native engine for text corpora, chats, pages and metric series."""
