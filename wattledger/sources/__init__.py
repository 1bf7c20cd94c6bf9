"""Reading logs, job tables and parameters; writing raw logs and results."""
