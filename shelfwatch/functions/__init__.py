"""Native column expressions; none of them leaves the JVM."""
