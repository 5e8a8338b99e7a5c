"""Expression helpers; everything here stays inside the JVM."""
