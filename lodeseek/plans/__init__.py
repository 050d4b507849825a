"""Plan helpers: sessions, staging, registered queries."""
