"""Rule catalogues as data, compiled to Column expressions."""
