"""Jobs and a thin HTTP interface."""
