"""Training-data operators on documents and web pages; nothing else in the library imports them."""
