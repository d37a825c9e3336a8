"""Order lifecycle, book states, per-message analytics and prediction labels as DataFrame plans."""
