"""Dense per-station linear algebra (NumPy) and its distributed front end."""
