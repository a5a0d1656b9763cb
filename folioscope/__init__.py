"""folioscope: document search and grounded answers as Spark DataFrame plans."""
