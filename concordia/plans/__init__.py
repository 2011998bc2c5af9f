"""Plans that score users."""
