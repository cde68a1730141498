"""Tables, files, JSON records and the views over the supplied test tables."""
