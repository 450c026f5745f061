"""Reading manuscripts and legends, writing results."""
