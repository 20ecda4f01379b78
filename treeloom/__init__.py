"""treeloom: structure-aware document comparison at corpus scale, as Spark plans."""
