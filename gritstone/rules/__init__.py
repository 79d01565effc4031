"""Rules: loading, checking and the two small compilers that turn their patterns into Java regular expressions."""
