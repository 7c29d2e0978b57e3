"""glyphlake: Spark-native curation of glyph-like record corpora."""
