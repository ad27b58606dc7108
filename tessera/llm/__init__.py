"""Training-data operators: thirteen jobs over text, pages, vectors and chats.

Nothing else in tessera imports this subpackage.
"""
