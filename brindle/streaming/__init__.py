"""Work that goes on in the background of a store. The engine has no streams."""
