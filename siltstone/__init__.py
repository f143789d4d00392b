"""siltstone: web-document analytics as Spark DataFrame transforms."""
