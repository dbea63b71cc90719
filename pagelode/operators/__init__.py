"""Relations of a corpus and the operations on them."""
