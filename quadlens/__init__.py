"""quadlens: Spark-native scoring of layered quad-mesh surfaces against independent evidence."""
