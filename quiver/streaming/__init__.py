"""Index upkeep from streams."""
