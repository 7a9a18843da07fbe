"""Log-line and text-corpus analytics as DataFrame transforms."""
