"""Filing and firm-panel analytics as DataFrame -> DataFrame operators on Apache Spark."""
