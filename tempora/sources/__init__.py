"""Sources and sinks: shredding JSON, XML and HTML to node tables, and the versioned store."""
