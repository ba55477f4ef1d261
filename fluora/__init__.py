"""fluora: PySpark-native analysis of fluorescence traces, spikes and connectivity graphs."""
