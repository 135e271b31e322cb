"""Search operators over tables of vectors."""
