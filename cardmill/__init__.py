"""cardmill: study-card analytics as PySpark DataFrame transforms."""
