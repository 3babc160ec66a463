"""Reading: tables, views and nested source documents."""
